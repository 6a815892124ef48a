"""What the operators share: the shared folder, size-checked joins, deterministic columns."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lodestrata.deploy import ship  # noqa: F401
from lodestrata.store import Left, release, scratch, stored  # noqa: F401

#: Words are runs of anything but ASCII white space.
WORD = r"[^\x20\x09-\x0D]+"
#: Rows of a table of ids and a few numbers that may be broadcast: about 40 MB.
BROADCAST_ROWS = 400_000

#: Hot keys are broadcast: HUBS of them at most, and none with fewer rows than HUB_ROWS.
HUBS, HUB_ROWS = 50_000, 64


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def maybe_broadcast(df: DataFrame, limit: int = BROADCAST_ROWS) -> DataFrame:
    """df with a broadcast hint if its counted rows are few; df must be cheap to count (stored)."""
    return F.broadcast(df) if df.count() <= limit else df


def join_counted(rows: DataFrame, counted: DataFrame, keys: list[str], total: int) -> DataFrame:
    """rows joined with counted (keys, k and other columns), one row for each key that k of all `total` rows have.

    Where all rows are BROADCAST_ROWS at most, so are the keys, and they are broadcast. Beyond it keys with over 1 / HUBS of
    all rows, HUBS of them at most, are broadcast, so that their rows stay in the tasks that read them; the others are
    joined by hash. rows and counted are then read twice and should be stored or cheap."""
    if total <= BROADCAST_ROWS:
        return rows.join(F.broadcast(counted.drop("k")), keys)
    bar = max(HUB_ROWS, total // HUBS)
    hot = F.broadcast(counted.filter(F.col("k") > bar).drop("k"))
    others = rows.join(hot.select(*keys), keys, "left_anti").join(counted.filter(F.col("k") <= bar).drop("k"), keys)
    return rows.join(hot, keys).unionByName(others)


def numbered(df: DataFrame, name: str, *order, tag: str = "sorted") -> DataFrame:
    """df with `name`, its rows' places from 0 in the order of columns that tell all rows apart, or whose ties are alike. Rows are
    sorted by ranges, so that a value with a third of all rows is many tasks if later columns tell its rows apart; a row's place
    is that in its task and the sizes of the tasks before, a row for each task. The sorted rows are stored."""
    mark, part, before = (fresh(df, x) for x in ("_mark", "_part", "_before"))
    done = stored(df.repartitionByRange(*order).sortWithinPartitions(*order).withColumn(mark, F.monotonically_increasing_id()), tag)
    done = done.withColumn(part, F.shiftright(mark, 33))
    sizes = done.groupBy(part).agg(F.count("*").alias("n"))
    starts = sizes.select(part, (F.sum("n").over(Window.orderBy(part)) - F.col("n")).alias(before))
    at = F.col(before) + F.col(mark).bitwiseAND(F.lit((1 << 33) - 1))
    return done.join(maybe_broadcast(starts), part).withColumn(name, at).drop(mark, part, before)


def without(df: DataFrame, *names: str) -> DataFrame:
    """df less its columns of these names: an operator's own columns replace columns of the input that clash with them."""
    low = {n.lower() for n in names}
    return df.drop(*[c for c in df.columns if c.lower() in low])


def aside(df: DataFrame, *names: str) -> tuple[DataFrame, list[Column]]:
    """df with its columns of these names, which an operator uses itself, renamed; and what brings all back under their names."""
    low = {n.lower() for n in names}
    moved = {c: fresh(df, f"_own_{c}") for c in df.columns if c.lower() in low}
    return df.withColumnsRenamed(moved), [F.col(moved[c]).alias(c) if c in moved else F.col(c) for c in df.columns]


def fresh(df: DataFrame, name: str) -> str:
    """name, with as many underscores behind it as it takes to be no column of df."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def doc_mod(n: int):
    """crc32 of doc_id as text, modulo n; a null doc_id counts as the empty text."""
    return F.pmod(F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")), F.lit(n))


def _crc_table() -> list[int]:
    out = list(range(256))
    for _ in range(8):
        out = [0xEDB88320 ^ (x >> 1) if x & 1 else x >> 1 for x in out]
    return out


def crc32_sql(texts: str) -> str:
    """DuckDB common table expressions (of WITH RECURSIVE) that end in crc (t, h): the unsigned crc32 of each distinct t of the
    query `texts`, of characters up to U+00FF."""
    step = f"xor({_crc_table()}[(xor(reg, bytes[k + 1]) & 255) + 1]::BIGINT, reg >> 8)"
    return f"""crc_bytes AS (
    SELECT t, flatten(list_transform(list_filter(string_split(t, ''), lambda x: x <> ''), lambda x: CASE WHEN ord(x) < 128 THEN [ord(x)::BIGINT] ELSE [192 + (ord(x)::BIGINT >> 6), 128 + (ord(x)::BIGINT & 63)] END)) AS bytes FROM (SELECT DISTINCT t FROM ({texts}))
), crc_step AS (
    SELECT t, bytes, 0 AS k, 4294967295::BIGINT AS reg FROM crc_bytes UNION ALL SELECT t, bytes, k + 1, {step} FROM crc_step WHERE k < len(bytes)
), crc AS (
    SELECT t, xor(reg, 4294967295) AS h FROM crc_step WHERE k = len(bytes)
)"""
