"""Settings of a package build, from Python or a command line, and the build itself."""

from __future__ import annotations

import argparse
import dataclasses
from collections.abc import Sequence
from pathlib import PurePosixPath

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ranklake.operators import fuse, pack

SOURCES = ("public", "train", "private")


@dataclasses.dataclass(frozen=True)
class BuildSettings:
    """What a package build depends on; ``output`` names the result after it, so two settings never share a name."""

    run: str = "run"
    out: str | None = None
    alpha: float = 0.0
    max_contexts: int = 3
    per_item: int = 350
    questions: str = "public"
    expected_median: int | None = None

    def __post_init__(self) -> None:
        if not 0.0 <= self.alpha <= 1.0:
            raise ValueError("alpha lies in 0 to 1")
        if self.max_contexts < 1 or self.per_item < 1:
            raise ValueError("max_contexts and per_item are 1 or more")
        if self.questions not in SOURCES:
            raise ValueError(f"questions is one of {', '.join(SOURCES)}")

    @property
    def output(self) -> str:
        if self.out is not None:
            return self.out
        return f"packages_{self.questions}_{PurePosixPath(self.run).stem}_alpha{self.alpha:g}_contexts{self.max_contexts}_tokens{self.per_item}"


def from_arguments(arguments: Sequence[str] | None = None) -> BuildSettings:
    """Each field is an option, as in ``--max-contexts 2``; a wrong value ends with the usual message."""
    parser = argparse.ArgumentParser(description="settings of a package build")
    kinds = {"alpha": float, "max_contexts": int, "per_item": int, "expected_median": int}
    for field in dataclasses.fields(BuildSettings):
        parser.add_argument("--" + field.name.replace("_", "-"), type=kinds.get(field.name, str), default=field.default, choices=SOURCES if field.name == "questions" else None)
    values = vars(parser.parse_args(arguments))
    try:
        return BuildSettings(**values)
    except ValueError as wrong:
        parser.error(str(wrong))


def build(settings: BuildSettings, ranked: DataFrame, units: DataFrame, questions: DataFrame) -> DataFrame:
    """Packages (id, question, contexts, reference_answer) of a run, as the settings say.

    ranked: (qid, rerank_rank, dense_rank, score, name, link, document_number) beside the columns of ``units``; questions: (qid,
    question, answer). Ranks are blended, clauses take in their neighbours up to ``per_item`` tokens, and contexts like a kept
    one are left out.
    """
    blended = fuse.blend(ranked, settings.alpha)
    texts = pack.decide_text(pack.expand_adjacent(blended, units, settings.per_item))
    kept = pack.greedy(texts, most=settings.max_contexts, text="formatted", body="body").select("qid", F.posexplode("picked").alias("place", "p"))
    rows = texts.drop("text", "title").withColumnsRenamed({"formatted": "text", "context_title": "title"}).join(kept.select("qid", "place", F.col("p.rank").alias("rank")), ["qid", "rank"])
    return pack.packages(rows.withColumn("item", pack.context_item()).select("qid", "place", "item"), questions)
