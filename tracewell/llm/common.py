"""Small helpers that several operators share."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: ASCII capitals to small letters, every other byte as it is.
LOWER = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))


def words(text: str | None) -> list[bytes]:
    """Lower-case (A-Z) runs of anything but space and \\t to \\r, as UTF-8; none for null."""
    return text.encode().translate(LOWER).split() if text else []


def remainder(key: str, modulus: int) -> Column:
    """crc32 of the key as text, modulo; -1 for a null key, so such a row is never held out."""
    return F.coalesce(F.pmod(F.crc32(F.col(key).cast("string").cast("binary")), F.lit(modulus)), F.lit(-1))


def arrow_rows(spark: SparkSession, rows: int = 1000) -> None:
    """Let a Python task hold at most so many rows (whole texts) at once."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if int(spark.conf.get(key, "10000")) != rows:
        spark.conf.set(key, str(rows))


def parts_of(rows: int, each: int) -> int:
    return max(1, -(-rows // each))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")
