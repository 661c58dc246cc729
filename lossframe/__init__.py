"""lossframe: a PySpark engine for cleaning and analysing loss-report tables."""

from .catalog import DEFAULT_CATALOG, Catalog  # noqa: F401
from .session import ensure_checkpoint_dir, get_spark  # noqa: F401

__version__ = "0.1.0"
