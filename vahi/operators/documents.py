"""What kind of document an upload is, and which uploads are let in."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

# Fixed values of upload admission.
MOST_BYTES, MOST_FILES = 20 * 1024 * 1024, 15


def detect_type(file_name: Column, extracted: Column) -> Column:
    """Bank by name or a `transactions` array; credit and debit notes by words of the name or by the text; receipts by name or as cash receipts; else invoice.

    extracted: JSON text or null; the whole document is searched.
    """
    name, body = F.lower(F.coalesce(file_name, F.lit(""))), F.lower(F.coalesce(extracted, F.lit("")))
    has_array = F.coalesce(F.get_json_object(extracted, "$.transactions").startswith("["), F.lit(False))
    any_of = lambda v, *words: F.greatest(*[F.contains(v, F.lit(w)) for w in words], F.lit(False))
    return (
        F.when(any_of(name, "bank", "statement", "passbook") | has_array, "bank").when(any_of(body, "credit note") | any_of(name, "credit", "_cn"), "credit_note")
        .when(any_of(body, "debit note") | any_of(name, "debit", "_dn"), "debit_note").when(any_of(name, "receipt") | any_of(body, "cash receipt"), "receipt").otherwise("invoice")
    )


def stored_type(kind: Column) -> Column:
    """C17: the type as invoices store it."""
    return F.when(kind == "credit_note", "CREDIT_NOTE").when(kind == "debit_note", "DEBIT_NOTE").when(kind == "receipt", "RECEIPT").when(kind == "bank", "BANK").otherwise("PURCHASE")


def admit(files: DataFrame, most_bytes: int = MOST_BYTES, most_files: int = MOST_FILES) -> DataFrame:
    """add verdict to files (batch, file_id, mime, bytes): wrong_type, too_large, too_many or admitted, the first files of a batch first."""
    fits = (F.col("mime").startswith("image/") | (F.col("mime") == "application/pdf")) & (F.col("bytes") <= most_bytes)
    nth = F.row_number().over(Window.partitionBy("batch", fits).orderBy("file_id"))
    verdict = F.when(~(F.col("mime").startswith("image/") | (F.col("mime") == "application/pdf")), "wrong_type").when(F.col("bytes") > most_bytes, "too_large").when(nth > most_files, "too_many").otherwise("admitted")
    return files.withColumn("verdict", verdict)


# The type of a file by its ending; an upload's own type is that.
ENDINGS = {"pdf": "application/pdf", "png": "image/png", "jpg": "image/jpeg", "jpeg": "image/jpeg", "webp": "image/webp", "gif": "image/gif", "tif": "image/tiff", "tiff": "image/tiff", "bmp": "image/bmp", "heic": "image/heic"}


def uploaded_files(spark: SparkSession, path: str, since: str | None = None) -> DataFrame:
    """the files below a folder, a batch each subfolder, with verdict; contents are not read. since: only files changed after this time, which the scan itself filters."""
    found = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    if since is not None:
        found = found.where(F.col("modificationTime") > F.lit(since).cast("timestamp"))
    parts = F.split("path", "/")
    ending = F.lower(F.regexp_extract("path", r"\.([A-Za-z0-9]+)$", 1))
    kinds = F.create_map(*[F.lit(x) for pair in ENDINGS.items() for x in pair])
    files = found.select("path", F.element_at(parts, -2).alias("batch"), F.element_at(parts, -1).alias("file_id"), F.coalesce(F.try_element_at(kinds, ending), F.lit("application/octet-stream")).alias("mime"), F.col("length").alias("bytes"), "modificationTime")
    return admit(files)


def admitted_contents(spark: SparkSession, path: str, admitted: DataFrame, most_bytes: int = MOST_BYTES) -> DataFrame:
    """Admitted files (path, ...) with content. The scan itself leaves out other types, by their ending, and larger files; files beyond a batch's limit fall to the join."""
    some = "*.{" + ",".join(x for e in ENDINGS for x in (e, e.upper())) + "}"
    found = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", some).load(path).where(F.col("length") <= most_bytes)
    return admitted.where("verdict = 'admitted'").drop("verdict").join(found.select("path", "content"), "path")
