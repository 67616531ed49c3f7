"""Source trees as tables."""

from __future__ import annotations

from pathlib import PurePosixPath
from urllib.parse import unquote, urlparse

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..functions.generated import is_generated
from ..functions.languages import BY_EXTENSION
from ..functions.paths import extension, in_pruned_dir, selected
from ..operators.skew import rank_in_walk


def _listed(spark: SparkSession, root: str, max_size: int) -> DataFrame:
    """(p, content): the files below root, or the one that it is, named from there. Size is tested before contents are read."""
    raw = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root).where(F.col("length") <= max_size)
    base = unquote(urlparse(root).path).rstrip("/")
    at = F.instr(F.col("path"), base + "/")
    inside = F.expr("substring(path, instr(path, :b) + length(:b))".replace(":b", "'" + (base + "/").replace("\\", "\\\\").replace("'", "\\'") + "'"))
    return raw.select(F.when(at > 0, inside).otherwise(F.lit(PurePosixPath(base).name)).alias("p"), "content")


def read_tree(
    spark: SparkSession, root: str, include: list[str] = (), exclude: list[str] = (), language: str = "", max_size: int = 5 * 1024 * 1024, generated: bool = False
) -> DataFrame:
    """(file_id, run_id, path, text) of the source files below root, or of the one file that root is, numbered in walk order.

    Size and path are tested before contents are read. Binary files are left out. A file is decoded as UTF-8. With `generated`, a column
    of that name tells machine-written files.
    """
    f = _listed(spark, root, max_size).where(~in_pruned_dir(F.col("p")) & selected(F.col("p"), list(include), list(exclude)))
    known = [e for e, n in BY_EXTENSION.items() if not language or n == language.lower()]
    f = f.where(extension(F.col("p")).isin(known))
    f = f.where(F.instr(F.decode(F.substring("content", 1, 512), "ISO-8859-1"), "\x00") == 0)
    ids = rank_in_walk(f.select("p"), "p").select("p", (F.col("rank") - 1).cast("int").alias("file_id"))
    out = f.select("p", F.decode("content", "UTF-8").alias("text")).join(ids, "p").select("file_id", F.lit(0).alias("run_id"), F.col("p").alias("path"), "text")
    return out.withColumn("generated", is_generated(F.col("path"), F.col("text"))) if generated else out


# Endings of files that are no source but may name functions.
TEXT_ENDINGS = (
    ".html .htm .erb .haml .slim .jinja .jinja2 .j2 .twig .ejs .hbs .mustache .tmpl .tpl .gotmpl .gohtml .vue .svelte .astro .yml .yaml .json .toml .xml .ini .cfg .md .mdx .rst .txt .s"
).split()


def read_texts(spark: SparkSession, root: str, max_size: int = 5 * 1024 * 1024) -> DataFrame:
    """(path, text) of files that are no source but may refer to it: templates, configuration, build files."""
    f = _listed(spark, root, max_size).where(~in_pruned_dir(F.col("p")) & extension(F.col("p")).isin(TEXT_ENDINGS))
    f = f.where(F.instr(F.decode(F.substring("content", 1, 512), "ISO-8859-1"), "\x00") == 0)
    return f.select(F.col("p").alias("path"), F.decode("content", "UTF-8").alias("text"))
