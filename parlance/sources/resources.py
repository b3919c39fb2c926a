"""Language resources as files of a folder: stop words, noise, stems, gazetteers and word clusters."""

from __future__ import annotations

import json
import shutil
import tempfile
import urllib.request
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from parlance.errors import ExistsError, MissingResourceError


def _lines(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.text(path).select(F.trim("value").alias("value")).where("value <> ''")


def stop_words(spark: SparkSession, path: str) -> DataFrame:
    """word, one a line."""
    return _lines(spark, path).select(F.col("value").alias("word")).distinct()


def gazetteer(spark: SparkSession, path: str) -> DataFrame:
    """value, one a line."""
    return _lines(spark, path).distinct()


def noise(spark: SparkSession, path: str) -> DataFrame:
    """ord, word: words between blanks, in the order of the file. One file is one task, so its order holds."""
    lines = spark.read.text(path, wholetext=True)
    return lines.select(F.posexplode(F.filter(F.split("value", r"\s+"), lambda w: w != "")).alias("ord", "word")).withColumn("ord", F.col("ord").cast("long"))


def clusters(spark: SparkSession, path: str) -> DataFrame:
    """word, cluster from tab-separated lines."""
    return spark.read.csv(path, sep="\t", schema="word string, cluster string")


def stems(spark: SparkSession, path: str) -> DataFrame:
    """form, stem from lines of a stem and its forms, separated by commas."""
    cut = _lines(spark, path).select(F.split("value", ",").alias("a"))
    return cut.select(F.explode(F.slice("a", 2, 1 << 30)).alias("form"), F.element_at("a", 1).alias("stem"))


READERS = {"stop_words": stop_words, "noise": noise, "stems": stems, "gazetteers": gazetteer, "word_clusters": clusters}


def load(spark: SparkSession, folder: str, required: dict[str, list[str]] | None = None) -> dict[str, dict[str, DataFrame]]:
    """Resources of a folder by kind and name. metadata.json there lists {kind: [names]}; a resource is the text file {kind}/{name}.txt.

    Only what is required is opened (default: all that is listed); what is not listed raises.
    """
    listed = json.loads("\n".join(r[0] for r in spark.read.text(f"{folder}/metadata.json").collect()))
    wanted = listed if required is None else required
    for kind, names in wanted.items():
        for name in names:
            if name not in listed.get(kind, []):
                raise MissingResourceError(f"{kind}/{name}")
    return {kind: {name: READERS[kind](spark, f"{folder}/{kind}/{name}.txt") for name in names} for kind, names in wanted.items()}


#: One line of a resource's text file from its row.
LINES = {"stop_words": "word", "noise": "word", "gazetteers": "value", "word_clusters": "concat_ws('\t', word, cluster)"}


def save_text(tables: dict[str, dict[str, DataFrame]], folder: str) -> None:
    """Write resources as the text files that `load` reads, and metadata.json; a language's resources are small. An existing folder is an error."""
    to = Path(folder)
    if to.exists():
        raise ExistsError(folder)
    for kind, named in tables.items():
        (to / kind).mkdir(parents=True)
        for name, df in named.items():
            if kind == "stems":
                lines = df.groupBy("stem").agg(F.array_join(F.array_sort(F.collect_set("form")), ",").alias("forms")).select(F.concat_ws(",", "stem", "forms").alias("line")).orderBy("line")
            else:
                lines = df.orderBy("ord" if kind == "noise" else df.columns[0]).selectExpr(f"{LINES[kind]} AS line")
            (to / kind / f"{name}.txt").write_text("".join(r["line"] + "\n" for r in lines.collect()), encoding="utf-8")
    (to / "metadata.json").write_text(json.dumps({kind: sorted(named) for kind, named in tables.items()}, indent=2))


def fetch(url: str, folder: str) -> str:
    """Get an archive of resources (.zip or .tar.gz) from a url, file:// included, and unpack it into a new folder below `folder`; gives that folder."""
    name = url.rstrip("/").rpartition("/")[2]
    stem = name.removesuffix(".zip").removesuffix(".tar.gz")
    to = Path(folder) / stem
    if to.exists():
        raise ExistsError(str(to))
    with tempfile.TemporaryDirectory() as held:
        at = Path(held) / name
        with urllib.request.urlopen(url) as got, at.open("wb") as out:  # noqa: S310 - the caller names the url
            shutil.copyfileobj(got, out)
        to.mkdir(parents=True)
        shutil.unpack_archive(str(at), str(to), filter="data") if name.endswith(".tar.gz") else shutil.unpack_archive(str(at), str(to))
    return str(to)


def link(folder: str, alias: str) -> None:
    """Give a folder of resources another name."""
    if not Path(folder).is_dir():
        raise MissingResourceError(folder)
    if Path(alias).exists():
        raise ExistsError(alias)
    Path(alias).parent.mkdir(parents=True, exist_ok=True)
    Path(alias).symlink_to(Path(folder).resolve(), target_is_directory=True)


def save(tables: dict[str, dict[str, DataFrame]], folder: str) -> None:
    """Write resources as Parquet, one folder each; an existing one is an error."""
    for kind, named in tables.items():
        for name, df in named.items():
            df.write.parquet(f"{folder}/{kind}/{name}")
