"""Rule documents: one JSON file per rule, identified by its file name."""

from __future__ import annotations

from concurrent.futures import ThreadPoolExecutor
from itertools import islice
from urllib.parse import unquote

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cellwarden.schemas import RULE_DOCUMENT

FILE_STEM = r"([^/]+)\.[^./]*$"
# Fixed value: pattern of the creation date in rule files.
DATE_PATTERN = "yyyy-MM-dd HH:mm:ss z"
#: Threads that rename written files.
RENAMERS = 8


def load_rules(spark: SparkSession, path: str, id_pattern: str = FILE_STEM) -> DataFrame:
    """Read rule files; ``rule_id`` is the part of the file path matched by ``id_pattern``."""
    documents = (
        spark.read.schema(RULE_DOCUMENT)
        .option("multiLine", True)
        .option("recursiveFileLookup", True)
        .json(path)
    )
    return documents.select(
        F.regexp_extract(F.col("_metadata.file_path"), id_pattern, 1).alias("rule_id"),
        *[c for c in documents.columns if c != "creation_date"],
        F.to_timestamp("creation_date", DATE_PATTERN).alias("creation_date"),
    )


def write_rules(rules: DataFrame, path: str) -> None:
    """Write each rule as a JSON file named by its ``rule_id``, as ``load_rules`` reads them.

    The tasks write and commit one file per rule into a folder below ``path`` that readers skip; the files are then renamed by ``RENAMERS``
    threads, as no writer of Spark takes names. Only names pass through the driver. Two rules with one id, or an id that is no
    file name, raise.
    """
    spark = rules.sparkSession
    fields = [F.date_format(c, DATE_PATTERN).alias(c) if c == "creation_date" else F.col(c) for c in rules.columns if c != "rule_id"]
    wrong = rules.groupBy("rule_id").count().where("count > 1 or rule_id is null or rule_id = '' or rule_id rlike '[/:]'").limit(1).collect()
    if wrong:
        raise ValueError(f"rule id {wrong[0]['rule_id']!r} occurs twice or names no file")
    staged = f"{path.rstrip('/')}/_staged"
    bodies = rules.select(F.col("rule_id").alias("stem"), F.to_json(F.struct(*fields), {"pretty": "true"}).alias("value"))
    # A number of partitions, because the rows are few bytes and would be put together into one task, which opens all files.
    tasks = max(int(spark.conf.get("spark.sql.shuffle.partitions")), spark.sparkContext.defaultParallelism)
    dealt = bodies.repartition(tasks, "stem").write.option("mapreduce.fileoutputcommitter.algorithm.version", "2")
    dealt.partitionBy("stem").text(staged)
    to_path = spark._jvm.org.apache.hadoop.fs.Path
    files, folder = to_path(staged).getFileSystem(spark._jsc.hadoopConfiguration()), to_path(path)

    def rename(stem_folder) -> None:
        stem = unquote(stem_folder.getName().removeprefix("stem="))
        for file in files.listStatus(stem_folder):
            if file.getPath().getName().startswith("part-") and not files.rename(file.getPath(), to_path(folder, f"{stem}.json")):
                raise OSError(f"{file.getPath()} could not be renamed to {stem}.json")

    written = (f.getPath() for f in files.listStatus(to_path(staged)) if f.isDirectory())
    with ThreadPoolExecutor(RENAMERS) as pool:
        while some := list(islice(written, 100 * RENAMERS)):
            list(pool.map(rename, some))
    files.delete(to_path(staged), True)
