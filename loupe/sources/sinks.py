"""Report parameters and per-cluster text files (S6 are the writers in ``operators.estimators``).

Text files are written one folder per label (``partitionBy``), each task
writing a sorted range of lines, so no label is funnelled through one task. A
folder that exists is only replaced on request, and only by a whole one.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable
from dataclasses import dataclass, field, fields
from typing import ClassVar

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loupe.operators import geometry as G
from loupe.operators import report, sample

# ---------------------------------------------------------------- S3
# fixed values: names and defaults of the report's options


@dataclass
class NgramTables:
    names: list = field(default_factory=lambda: ["bigram", "bigram_stem"])
    k: int = 10
    additional_stopwords: dict = field(default_factory=dict)


@dataclass
class WordClouds:
    names: list = field(default_factory=lambda: ["unigram", "unigram_stem"])
    types: list = field(default_factory=lambda: [["NOUN", "VERB", "ADJ", "ADV", "PROPN", "PART"]])
    additional_stopwords: dict = field(default_factory=dict)
    max_words: int = 20


@dataclass
class Texts:
    random: int = 10
    central_sentences: int = 10


@dataclass
class Diagnostics:
    """On unless said otherwise; for the mahalanobis metric, where they cost most, off unless asked for."""

    center_distance_density: bool | None = None
    distance_between_clusters: bool | None = None
    silhouettes: bool | None = None


@dataclass
class ReportOptions:
    """S3: the options of a report, complete and checked. Parts are given as dicts of what differs from the defaults."""

    metric: str = "cosine"
    ngrams: NgramTables | dict | None = None
    clouds: WordClouds | dict | None = None
    texts: Texts | dict | None = None
    diagnostics: Diagnostics | dict | None = None

    METRICS: ClassVar = ("cosine", "euclidean", "mahalanobis")
    PARTS: ClassVar = {"ngrams": NgramTables, "clouds": WordClouds, "texts": Texts, "diagnostics": Diagnostics}

    def __post_init__(self):
        if self.metric not in self.METRICS:
            raise ValueError(f"metric must be one of {self.METRICS}")
        for name, kind in self.PARTS.items():
            given = getattr(self, name) or {}
            if not isinstance(given, kind):
                if unknown := sorted(set(given) - {f.name for f in fields(kind)}):
                    raise ValueError(f"unknown options of {name}: {unknown}")
                setattr(self, name, kind(**given))
        for f in fields(Diagnostics):
            if getattr(self.diagnostics, f.name) is None:
                setattr(self.diagnostics, f.name, self.metric != "mahalanobis")


# ---------------------------------------------------------------- S5

def subtitles(summary: DataFrame) -> DataFrame:
    """``label = 0, n = 10, sentiment = 0.12`` (``NA`` without sentiment)."""
    sent = F.coalesce(F.col("sentiment").cast("string"), F.lit("NA"))
    return summary.select("label", F.concat(F.lit("label = "), F.col("label").cast("string"),
                                            F.lit(", n = "), F.col("n").cast("string"),
                                            F.lit(", sentiment = "), sent).alias("subtitle"))


def text_lines(entries: DataFrame, summary: DataFrame) -> DataFrame:
    """S5 layout as rows ``(label, line_no, line)``.

    ``entries`` holds ``(label, rank, entry)``; line 0 is the subtitle and
    entries follow in rank order. Labels without entries still get their
    subtitle.
    """
    head = subtitles(summary).select("label", F.lit(0).cast("bigint").alias("line_no"),
                                     F.col("subtitle").alias("line"))
    body = entries.select("label", F.col("rank").cast("bigint").alias("line_no"), F.col("entry").alias("line"))
    return head.unionByName(body)


def central_entries(central: DataFrame) -> DataFrame:
    """Central entries are ``round(distance, 2), text``."""
    return central.select("label", "rank", F.concat(report.format_distance(F.col("distance")),
                                                    F.lit(", "), F.coalesce(F.col("text"), F.lit("")))
                          .alias("entry"))


def random_entries(sampled: DataFrame) -> DataFrame:
    return sampled.select("label", F.col("sample_rank").alias("rank"), F.col("text").alias("entry"))


def write_text(lines: DataFrame, path: str, title: str, sep: str = "\n \n", overwrite: bool = False) -> None:
    """S5 sink: text files under ``path/label=<l>/``, one label's lines in the order of the file names.

    The first file of a label starts with the title, then come the subtitle and the
    entries, each followed by ``sep``. Ranges of (label, line) are sorted and
    written by a task each, so a label of any length is spread over tasks. All is
    written to a folder beside ``path`` and renamed when whole: a failure leaves
    nothing, and a folder that exists is only replaced on ``overwrite``.
    """
    first = F.when(F.col("line_no") == 0, F.concat(F.lit(title + "\n \n \n"), "line")).otherwise(F.col("line"))
    rows = lines.select("label", "line_no", first.alias("value")).repartitionByRange("label", "line_no").sortWithinPartitions("label", "line_no")
    folder = Folder(lines.sparkSession, path)
    if folder.exists() and not overwrite:
        raise FileExistsError(f"{path} exists; pass overwrite=True to replace it")
    folder.replaced_by(lambda part: rows.select("label", "value").write.option("lineSep", sep).partitionBy("label").text(part))


class Folder:
    """A folder of any file system that Spark writes to."""

    def __init__(self, spark: SparkSession, path: str):
        self.jvm, self.path = spark._jvm, path.rstrip("/")
        self.fs = self._at(self.path).getFileSystem(spark._jsc.hadoopConfiguration())

    def _at(self, path: str):
        return self.jvm.org.apache.hadoop.fs.Path(path)

    def exists(self) -> bool:
        return self.fs.exists(self._at(self.path))

    def replaced_by(self, write: Callable[[str], None]) -> None:
        """Let ``write`` fill a new folder and give it this name; what was here goes only when that is whole."""
        part = f"{self.path}.{uuid.uuid4().hex}"
        try:
            write(part)
            if self.exists():
                self.fs.delete(self._at(self.path), True)
            elif (above := self._at(self.path).getParent()) is not None:
                self.fs.mkdirs(above)
            if not self.fs.rename(self._at(part), self._at(self.path)):
                raise OSError(f"{part} could not be renamed to {self.path}")
        finally:
            self.fs.delete(self._at(part), True)


# ---------------------------------------------------------------- S4

def cluster_text(reviews: DataFrame, vectors: DataFrame, centers, text_params: dict, metric: str = "cosine",
                 precisions=None, seed: int = 0) -> dict[str, DataFrame]:
    """S4 tables: ``random`` and ``central`` line tables (as wanted).

    ``reviews`` is ``(review_id, text, label[, sentiment])``; ``vectors`` is
    ``(review_id, embedding, label)``.
    """
    sent = "sentiment" if "sentiment" in reviews.columns else None
    summary = report.cluster_summary(reviews, "label", sent)
    out = {}
    if text_params.get("random", 0) > 0:
        s = sample.sample_reviews(reviews, int(text_params["random"]), seed)
        out["random_sentences"] = text_lines(random_entries(s), summary)
    if text_params.get("central_sentences", 0) > 0:
        c = G.central_reviews(vectors, centers, int(text_params["central_sentences"]),
                              reviews.select("review_id", "text"), metric, precisions)
        out["central_sentences"] = text_lines(central_entries(c), summary)
    return out


TITLES = {"random_sentences": "randomly sampled reviews",
          "central_sentences": "sentences that are close to the cluster centers"}


def write_cluster_text(path: str, tables: dict[str, DataFrame], overwrite: bool = False) -> None:
    for name, lines in tables.items():
        write_text(lines, f"{path.rstrip('/')}/{name}", TITLES[name], overwrite=overwrite)
