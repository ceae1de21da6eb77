"""Docstring curation, training pairs and the quality report."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from codequarry.functions import text as T
from codequarry.functions import vectors as V
from codequarry.operators.aggregates import dedup_first, histogram_compare
from codequarry.operators.joins import pair_vectors
from codequarry.operators.sampling import is_test
from codequarry.operators.search import pairwise_similarity

# Bins of a similarity histogram; longest docstring brought back.
SIMILARITY_BINS = 100
RETURN_SHORTER_THAN = 120


def judge_summaries(
    short: DataFrame,
    doc_vectors: DataFrame,
    short_vectors: DataFrame,
    threshold: float = T.DISTANCE_THRESHOLD,
    key: str = "id",
) -> DataFrame:
    """``short`` with the distance of docstring and summary and the text to keep.

    The vectors meet on the key. A row lacking a vector has no distance and so
    falls to the rules that need none.
    """
    pairs = pair_vectors(doc_vectors, short_vectors, key)
    distances = pairs.select(key, V.l2(F.col("a"), F.col("b")).alias("distance"))
    kept = T.keep_rule(
        F.col("docstring"), F.col("short_docstring"), F.col("distance"), threshold=threshold
    )
    return short.join(distances, key, "left").withColumn("filtered_docstring", kept)


def curate(
    functions: DataFrame,
    judged: DataFrame,
    return_shorter_than: int = RETURN_SHORTER_THAN,
    key: str = "id",
) -> DataFrame:
    """The curated set: kept summaries, plus brief docstrings of all other functions.

    Functions whose summary was dropped count as "other", so a brief one
    returns. It has no filtered text. One full join on the key decides both
    parts, so neither table is read or moved twice.
    """
    kept = F.col("j.filtered_docstring").isNotNull()
    brief = F.length("f.docstring") < return_shorter_than
    both = functions.where("docstring IS NOT NULL").alias("f").join(
        judged.drop("distance").alias("j"), F.col(f"f.{key}") == F.col(f"j.{key}"), "full"
    )
    columns = []
    for name in dict.fromkeys([*judged.columns, *functions.columns]):
        if name == "distance":
            continue
        other = F.col(f"f.{name}") if name in functions.columns else F.lit(None)
        value = F.when(kept, F.col(f"j.{name}")) if name in judged.columns else F.when(kept, None)
        columns.append(value.otherwise(other).alias(name))
    return both.where(kept | F.coalesce(brief, F.lit(False))).select(*columns)


def training_pairs(
    curated: DataFrame,
    key: str = "id",
    test_share: float = 0.15,
    seed: int = 42,
    args_are_text: bool = False,
) -> DataFrame:
    """(key, x, y, part): function text and target text, one row per target.

    The target is the filtered text, or the docstring where there is none.
    """
    target = F.coalesce("filtered_docstring", "docstring")
    aimed = curated.withColumn("y", target).where("y IS NOT NULL")
    unique = dedup_first(aimed, ["y"], [key])
    args = T.format_args(F.col("args")) if args_are_text else T.format_arg_list(F.col("args"))
    part = F.when(is_test(key, test_share, seed), "test").otherwise("train")
    return unique.select(
        key, T.render_function(F.col("name"), args, F.col("body")).alias("x"), "y", part.alias("part")
    )


def quality_report(
    code: DataFrame,
    summaries: dict[str, DataFrame],
    bins: int = SIMILARITY_BINS,
    key: str = "id",
    metric: str = "cosine",
) -> DataFrame:
    """Density of the likeness of code and text vectors, per kind of text.

    ``summaries`` maps a label to a vector table keyed as ``code`` is.
    """
    scored: dict[str, DataFrame] = {
        label: pairwise_similarity(code, texts, key, metric) for label, texts in summaries.items()
    }
    return histogram_compare(scored, "score", bins)


def summary_requests(functions: DataFrame, keep: Sequence[str] = ("id",)) -> DataFrame:
    """Prompts for the functions that have a docstring."""
    prompt = T.summary_prompt(F.col("docstring"), F.col("body"))
    return functions.where(F.col("docstring").isNotNull()).select(*keep, prompt.alias("prompt"))


def embedding_requests(functions: DataFrame, cap: int | None = None) -> DataFrame:
    """(id, text): function texts, cut to ``cap`` characters if a model takes no more."""
    args = T.format_arg_list(F.col("args"))
    rendered = T.render_function(F.col("name"), args, F.col("body"))
    text = rendered if cap is None else T.cap(rendered, cap)
    return functions.select("id", text.alias("text"))
