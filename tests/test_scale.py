"""Fast paths give what the long ones give; wide writes run compiled and in small parts."""

from pyspark.sql import functions as F

from lossframe.catalog import DEFAULT_CATALOG as CAT, NULL_TOKENS
from lossframe.functions import exprs as X
from lossframe.operators import clean as C
from lossframe.session import scratch_path, write_parquet

CELLS = ["0", "-0", "007", "12.5", "1e5", "+5", "-5", " 5", "5\n", "10-20", "1,234", "１２", "999999999999999", "9999999999999999", "12345678901234567890123",
         "3万元", "12亩", "0.5亿元", "5 人", "　5　", "12.0", "12.0\n", "1.0.0", ".0", "\x005", "T 3", "T3", "N/A ", "n/A", "Nan", "nanx", "-", "--", "---", "/", "//", "无", "不详 ", None,
         *NULL_TOKENS]


def cells(spark):
    return spark.createDataFrame([(i, c) for i, c in enumerate(CELLS)], "id int, c string")


def shown(df):
    return [tuple(map(repr, r)) for r in df.orderBy("id").collect()]


def test_digits_are_read_without_the_regex(spark):
    df = cells(spark)
    m = "direct_economic_loss"
    raw = C.to_standard(df.withColumnRenamed("c", m), seq_col="id")
    got = C.parse_stage(raw).select(F.col("_seq").alias("id"), m, f"_conv_{m}")
    text = X.quantity_text("c")
    number, factor = X.number_of_text(text), X.factor_of_text(text, CAT.metric(m).units)
    want = df.select(F.col("id").cast("long").alias("id"), (number * factor).alias(m), (number.isNotNull() & (factor != 1)).alias(f"_conv_{m}"))
    assert shown(got) == shown(want)
    read = df.select("id", X.plain_integer("c").alias("n")).where("n IS NOT NULL")
    assert [CELLS[r.id] for r in read.orderBy("id").collect()] == ["0", "007", "999999999999999"]


def test_plain_texts_and_codes_are_kept_as_the_long_way_does(spark):
    df = cells(spark)
    missing = X.is_missing("c")
    text = F.when(~missing, X.strip_all_ws("c"))
    code = F.when(~missing, X.trim_ws(F.regexp_replace("c", r"\.0$", "")))
    assert shown(df.select("id", X.normalize_text("c"), X.normalize_code("c"))) == shown(df.select("id", text, code))


def test_dates_need_their_separators(spark):
    texts = ["1995-3-4", "1995/3/4", "1995.03.04", "1995年3月4日", "1995年3月", "19950304", "1995-03", "1995/03", "1995", "1995-03-04 08:30", "1995-03-04t08:30:15",
             "1995-03-04T08:30:15", "1995/3/4 8:30", "1995年3月4日 8:30:1", " 1995-03-04　", "1995-03-04 ", "95-3-4", "1995-13-04", "44927", "20:15", "1995-3/4", "-", None]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "id int, c string")
    formats = CAT.rules["date_formats"]
    tried = [F.try_to_timestamp(X.trim_ws("c"), F.lit(X.java_pattern(f))) for f in (*formats, *X.DATE_TIMES)]
    want = F.when(~X.is_missing("c"), F.coalesce(*tried).cast("timestamp_ntz"))
    assert shown(df.select("id", X.parse_date("c", formats))) == shown(df.select("id", want))


def test_wide_writes_run_compiled_and_in_small_parts(spark):
    keys = ("spark.sql.codegen.hugeMethodLimit", "spark.sql.files.maxPartitionBytes")
    saved = {k: spark.conf.get(k, None) for k in keys}
    spark.conf.set(keys[0], 65535)
    spark.conf.set(keys[1], 1 << 30)
    seen = []
    try:
        set_before = {k: spark.conf.get(k) for k in keys}
        df = spark.range(10).withColumn("year", F.col("id") % 2)
        write = type(df.write).parquet

        def watched(self, *args, **kwargs):
            seen.append([int(spark.conf.get(k)) for k in keys])
            return write(self, *args, **kwargs)

        type(df.write).parquet = watched
        try:
            assert write_parquet(df, scratch_path(spark, "wide"), "year").count() == 10
        finally:
            type(df.write).parquet = write
        assert seen == [[8000, 16 << 20]] and {k: spark.conf.get(k) for k in keys} == set_before
    finally:
        for k, v in saved.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)
