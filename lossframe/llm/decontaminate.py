"""Benchmark decontamination with a hash set of normalised word n-grams.

Words are ``[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+`` after lower-casing A-Z. A
benchmark window is ``n`` consecutive words of an item; an item of fewer
words, but not none, is one window. The distinct windows become a hash set
held in the plan. Each document's token windows are hashed and looked up in
the set; each hit is verified on its words; a document word inside any
verified window is hit. A document is contaminated if at least one word in
``1 / share`` is hit. All of it is one scan of the documents with Spark's own
functions and no shuffle. Beyond ``MAX_GRAMS`` distinct pairs of a window and an
item the set is a table (``scan_joined``), with equal results: the hashes of the
first two words are broadcast, only positions that begin like a window go on,
as (row id, position, hash), and words are compared for hash hits alone.

Cases: null or wordless texts have no words and no hits; wordless and null
items have no windows; an item without an id has windows that hit, but is not
counted or named among the items; repeated documents each get a row, repeated
items of one id count once; windows that several items share count for each; an
empty benchmark hits nothing; given columns pass through ``clean_documents`` and
``clean_spans`` untouched, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from lossframe.llm.common import lower_ascii, small_side, table, written

#: Distinct pairs of a benchmark window and an item that the plan may hold; about 150 bytes each.
MAX_GRAMS = 50_000
_SEP = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]"
_SEPARATORS = "".join(c for c in map(chr, range(128)) if not c.isalnum())
_HITS = "array<struct<at:int,n:int,items:array<string>>>"
_NONE = "cast(array() as array<string>)"


def words(text: Column) -> Column:
    """Array of the words; a null text has none. Trimming first leaves no empty words to filter out."""
    inner = F.btrim(F.coalesce(text, F.lit("")), F.lit(_SEPARATORS))
    return F.when(inner == "", F.expr("cast(array() as array<string>)")).otherwise(F.split(lower_ascii(inner), _SEP + "+"))


def grams(benchmark: DataFrame, n: int = 13) -> DataFrame:
    """Distinct (k, gram, h, begin, item_id): windows of ``k`` words, ``h`` and ``begin`` hash all and the first two, with the items they are in."""
    w = benchmark.select(F.col("item_id").cast("string").alias("item_id"), words(F.col("text")).alias("w")).filter("size(w) > 0")
    k = F.least(F.size("w"), F.lit(n))
    w = w.select("item_id", F.explode(F.transform(F.sequence(F.lit(1), F.size("w") - k + 1), lambda i: F.slice("w", i, k))).alias("g"))
    return w.distinct().select(
        F.size("g").alias("k"), F.array_join("g", " ").alias("gram"), F.xxhash64("g").alias("h"),
        F.xxhash64(F.get("g", F.lit(0)), F.get("g", F.lit(1))).alias("begin"), "item_id")


def _literal(rows: list, buckets: int) -> str:
    """SQL of an array of ``buckets`` arrays of (gram, items): the hash set's entries by their hash."""
    by: list[list[str]] = [[] for _ in range(buckets)]
    for r in rows:
        items = ",".join("'" + i.replace("\\", "\\\\").replace("'", "\\'") + "'" for i in r.items)
        by[r.h % buckets].append(f"named_struct('gram','{r.gram}','items',array({items}))")
    none = "cast(array() as array<struct<gram:string,items:array<string>>>)"
    return "array(" + ",".join(f"array({','.join(b)})" if b else none for b in by) + ")"


def scan(docs: DataFrame, benchmark: DataFrame, n: int = 13) -> DataFrame:
    """Add ``w`` (words), ``hits`` (verified windows) and ``items`` (ids, sorted as strings) to the documents, under ``doc``."""
    pairs = written(grams(benchmark, n), "decontaminate-grams")
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("doc")).withColumn("w", words(F.col("doc.text")))
    if pairs.count() > MAX_GRAMS:
        return scan_joined(rows, pairs)
    found = [_Gram(r) for r in pairs.groupBy("k", "gram", "h", "begin").agg(F.array_sort(F.collect_set("item_id")).alias("items")).collect()]
    size = len(found)
    if not found:
        return rows.withColumn("hits", F.expr(f"cast(array() as {_HITS})")).withColumn("items", F.expr(_NONE))
    parts = []
    for k in sorted({r.k for r in found}):
        own = [r for r in found if r.k == k]
        buckets = max(1, size // 2)
        hashes = ",".join(f"bigint('{r.h}')" for r in own)
        window = f"xxhash64(slice(w, {{}}, {k})) in ({hashes})"
        if k > 2:  # a window can only be in the set if its first two words begin one
            pairs = ",".join(sorted({f"bigint('{r.begin}')" for r in own}))
            window = f"xxhash64(w[{{}} - 1], w[{{}}]) in ({pairs}) and " + window
        at = f"filter(case when size(w) >= {k} then sequence(1, size(w) - {k - 1}) else cast(array() as array<int>) end, i -> {window.replace('{}', 'i')})"
        bucket = f"element_at({_literal(own, buckets)}, cast(pmod(xxhash64(slice(w, i, {k})), {buckets}) as int) + 1)"
        parts.append(f"filter(transform({at}, i -> named_struct('at', i, 'n', {k}, 'items', "
                     f"get(filter({bucket}, e -> e.gram = array_join(slice(w, i, {k}), ' ')), 0).items)), y -> y.items is not null)")
    rows = rows.withColumn("hits", F.expr(f"concat({', '.join(parts)})" if len(parts) > 1 else parts[0]).cast(_HITS))
    return rows.withColumn("items", F.array_sort(F.array_distinct(F.flatten(F.transform("hits", lambda x: x["items"])))))


class _Gram:
    def __init__(self, row):
        self.k, self.gram, self.h, self.begin, self.items = row["k"], row["gram"], row["h"], row["begin"], list(row["items"])


def scan_joined(rows: DataFrame, pairs: DataFrame) -> DataFrame:
    """``scan`` for a benchmark of any size.

    Windows are exploded as numbers, without text, and those that don't begin like a benchmark window go before
    any shuffle as long as the beginnings can be broadcast. Documents are joined by row id with what was found in them.
    """
    rows = written(rows.withColumn("row_id", F.monotonically_increasing_id()), "decontaminate-rows")
    sets = written(pairs.select("k", "gram", "h", "begin").distinct().withColumn("gram_id", F.monotonically_increasing_id()), "decontaminate-windows")
    items = written(pairs.filter("item_id is not null").join(sets.select("gram", "gram_id"), "gram").select("gram_id", "item_id"), "decontaminate-items")
    n = sets.count()
    lengths = [r.k for r in sets.select("k").distinct().collect()]  # as many as a window has words, at most
    wins = F.concat(*[F.expr(
        f"transform(case when size(w) >= {k} then sequence(1, size(w) - {k - 1}) else cast(array() as array<int>) end, "
        f"i -> named_struct('at', i, 'k', {k}, 'begin', xxhash64(w[i - 1], get(w, i)), 'h', xxhash64(slice(w, i, {k}))))") for k in lengths])
    # a window of one word has no second one to begin with
    begins = sets.select("k", F.when(F.col("k") > 1, F.col("begin")).otherwise(F.col("h")).alias("begin")).distinct()
    at = rows.select("row_id", F.explode(wins).alias("x")).select(
        "row_id", "x.at", "x.k", F.when(F.col("x.k") > 1, F.col("x.begin")).otherwise(F.col("x.h")).alias("begin"), "x.h")
    at = at.join(small_side(begins, n), ["k", "begin"], "left_semi").select("row_id", "at", "k", "h")
    maybe = written(at.join(small_side(sets.select("k", "h", "gram_id", "gram"), 8 * n), ["k", "h"]), "decontaminate-maybe")
    by_row = maybe.groupBy("row_id").agg(F.collect_list(F.struct("at", "k", "gram_id", "gram")).alias("maybe"))
    seen = rows.select("row_id", "w").join(small_side(by_row, maybe.count()), "row_id")
    true = F.filter("maybe", lambda x: F.array_join(F.slice("w", x["at"], x["k"]), " ") == x["gram"])
    hits = written(seen.select("row_id", F.transform(true, lambda x: F.struct(x["at"].alias("at"), x["k"].alias("n"), x["gram_id"].alias("gram_id"))).alias("hits"))
                   .filter("size(hits) > 0"), "decontaminate-hits")
    named = hits.select("row_id", F.explode(F.array_distinct(F.col("hits.gram_id"))).alias("gram_id")).join(items, "gram_id").groupBy("row_id").agg(
        F.array_sort(F.collect_set("item_id")).alias("items"))
    found = written(hits.join(named, "row_id", "left"), "decontaminate-found")
    none = F.expr(f"cast(array() as {_HITS})")
    shown = F.transform("hits", lambda x: F.struct(x["at"].alias("at"), x["n"].alias("n"), F.expr(_NONE).alias("items"))).cast(_HITS)
    both = rows.join(small_side(found.select("row_id", shown.alias("hits"), "items"), found.count()), "row_id", "left")
    return both.select("doc", "w", F.coalesce("hits", none).alias("hits"), F.coalesce("items", F.expr(_NONE)).alias("items"))


def _hit_words() -> Column:
    return F.expr("array_distinct(flatten(transform(hits, x -> sequence(x.at, x.at + x.n - 1))))")


def report(docs: DataFrame, benchmark: DataFrame, n: int = 13, share: int = 20) -> DataFrame:
    """One row for each document: doc (a struct of the given columns), n_words, n_hit, n_items, items_sha256, contaminated."""
    rows = scan(docs, benchmark, n).select(
        "doc", F.size("w").cast("long").alias("n_words"),
        F.when(F.size("hits") == 0, F.lit(0)).otherwise(F.size(_hit_words())).cast("long").alias("n_hit"),
        "items")
    return rows.select("doc", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"),
                       F.sha2(F.array_join("items", ","), 256).alias("items_sha256"),
                       ((F.col("n_hit") > 0) & (F.col("n_hit") * share >= F.col("n_words"))).alias("contaminated"))


def clean_documents(docs: DataFrame, benchmark: DataFrame, n: int = 13, share: int = 20) -> DataFrame:
    """The given rows without contaminated documents, columns as given."""
    # A generator keeps the rows: a filter would be pushed below the steps of the scan and repeat them inside their lambdas.
    kept = report(docs, benchmark, n, share).select(F.explode(F.when(~F.col("contaminated"), F.array("doc"))).alias("doc"))
    return kept.select(*[F.col("doc").getField(c).alias(c) for c in docs.columns])


def clean_spans(docs: DataFrame, benchmark: DataFrame, n: int = 13) -> DataFrame:
    """The given rows with hit words, and the separators before them, cut out of ``text``."""
    other = r"\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F"  # the text keeps its capitals
    text, piece = F.coalesce(F.col("doc.text"), F.lit("")), f"[{other}]*+[^{other}]++"
    rows = scan(docs, benchmark, n).withColumn("bad", _hit_words()).withColumn("pieces", F.regexp_extract_all(text, F.lit(f"({piece})"), 1))
    cut = F.concat(F.expr("array_join(filter(pieces, (p, i) -> not array_contains(bad, i + 1)), '')"), F.substr(text, F.length(F.rtrim(text, F.lit(_SEPARATORS))) + 1))
    return rows.select(*[(F.when(F.size("bad") > 0, cut).otherwise(F.col("doc.text")) if c == "text" else F.col("doc").getField(c)).alias(c)
                         for c in docs.columns])


def op1_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return report(docs, table(spark, sf_dir, "benchmark")).select(
        F.col("doc.doc_id").alias("doc_id"), "n_words", "n_hit", "n_items", "items_sha256", "contaminated")


ORACLE = r"""
WITH dw AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                              '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
bw AS (SELECT item_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                          '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark WHERE text IS NOT NULL),
bk AS (SELECT item_id, w, least(len(w), 13) AS k FROM bw WHERE len(w) > 0),
g AS (SELECT DISTINCT item_id, k, array_to_string(w[i:i + k - 1], ' ') AS gram
      FROM (SELECT item_id, w, k, unnest(range(1, len(w) - k + 2)) AS i FROM bk)),
dg AS (SELECT doc_id, k, i, array_to_string(w[i:i + k - 1], ' ') AS gram
       FROM (SELECT doc_id, w, k, unnest(range(1, len(w) - k + 2)) AS i FROM dw, (SELECT DISTINCT k FROM g) WHERE len(w) >= k)),
h AS (SELECT doc_id, dg.k, i, item_id FROM dg JOIN g ON dg.gram = g.gram AND dg.k = g.k),
pos AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + k)) AS p FROM h) GROUP BY doc_id),
it AS (SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items
       FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS item FROM h) GROUP BY doc_id)
SELECT dw.doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
       sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated
FROM dw LEFT JOIN pos USING (doc_id) LEFT JOIN it USING (doc_id)
"""
