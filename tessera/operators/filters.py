"""Selections of runs and of documents, and the small projections that go with them."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: The canonical run.
CYCLES, TRIALS, WIDTH, HEIGHT = 30, 10, 1024, 768
#: Numbers of the outcomes, and which text in a message means which.
NONE, COMPILATION, INCONSISTENT, TIMEOUT, SAME, NOT_RUN, OTHER = 0, 1, 2, 3, 4, 5, 100
ERROR_RULES = (("ShaderResultInconsistencyException", INCONSISTENT), ("ShaderCompilationException", COMPILATION), ("too long to respond", TIMEOUT))
#: Suffixes that the sources of each channel type may have.
MEDIA = {"texture": (".jpg", ".png"), "music": (".mp3",), "cubemap": (".jpg", ".png")}


def canonical_runs(runs: DataFrame, shader=None, untraced: bool = False, environment=None) -> DataFrame:
    """Runs without error at the canonical size and counts; optionally of one shader, of one environment, without a trace."""
    out = runs.where((F.col("num_cycles") == CYCLES) & (F.col("num_trials") == TRIALS) & (F.col("width") == WIDTH) & (F.col("height") == HEIGHT) & (F.col("errors") == 0))
    if shader is not None:
        out = out.where(F.col("shader") == shader)
    if environment is not None:
        out = out.where(F.col("environment") == environment)
    return out.where(F.col("trace").isNull()) if untraced else out


def not_listed(df: DataFrame, key: str, listed: DataFrame) -> DataFrame:
    """Rows whose key is not in the list; null keys go, as with NOT IN."""
    return df.where(F.col(key).isNotNull()).join(listed.select(key).distinct(), key, "left_anti")


def within_length(df: DataFrame, lengths: DataFrame, key: str, most: int) -> DataFrame:
    """Rows whose length is known and at most `most`."""
    return df.join(lengths.where(F.col("length") <= most).select(key), key, "left_semi")


def kept_share(df: DataFrame, lengths: DataFrame, key: str, most: int) -> DataFrame:
    """One row: n, kept, share of rows within the length; rows without a length are not kept."""
    out = df.join(lengths.select(key, "length"), key, "left").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("length") <= most).alias("kept"))
    return out.withColumn("share", F.try_divide(F.col("kept"), F.col("n")))


def all_true(df: DataFrame, attributes: Mapping[str, Column], wanted: Sequence[str]) -> DataFrame:
    """Rows for which all wanted attributes hold (null does not)."""
    return df.where(reduce(lambda a, b: a & b, [F.coalesce(attributes[w], F.lit(False)) for w in wanted], F.lit(True)))


def only_passes(passes: Column, kinds: Sequence[str]) -> Column:
    """Whether every pass in an array of structs is of one of the kinds."""
    return F.forall(passes, lambda p: p["type"].isin(list(kinds)))


def first_pass(passes: Column, kind: str) -> Column:
    return F.try_element_at(F.filter(passes, lambda p: p["type"] == kind), F.lit(1))


def passes_of(passes: Column, kind: str) -> Column:
    """All passes of one kind, in order; null for null."""
    return F.filter(passes, lambda p: p["type"] == kind)


def channels(docs: DataFrame, id: str, passes: Column) -> DataFrame:
    """Rows (id, pass_no, channel, src, ctype) of the inputs of every pass."""
    each = docs.select(id, F.posexplode(passes).alias("pass_no", "_p"))
    return each.select(id, "pass_no", F.explode("_p.inputs").alias("i")).select(id, "pass_no", "i.channel", "i.src", "i.ctype")


def media_list(inputs: DataFrame, rules: Mapping[str, Sequence[str]] = MEDIA) -> DataFrame:
    """Rows (src, ctype, problem, n): each source once, of the types that have media or are unknown, and what is wrong with it."""
    return check_suffix(inputs, "src", F.col("ctype"), rules).groupBy("src", "ctype", "problem").agg(F.count(F.lit(1)).alias("n"))


def node_runs(runs: DataFrame, environments: DataFrame, shaders: DataFrame, node: str, cycles: int, trials: int, blacklist: DataFrame) -> DataFrame:
    """Runs of a node at fixed counts with their program, without the listed programs; runs without a program go."""
    env = environments.where(F.col("node") == node).select(F.col("id").alias("environment"))
    good = runs.where((F.col("num_cycles") == cycles) & (F.col("num_trials") == trials) & (F.col("errors") == NONE)).join(env, "environment")
    return not_listed(good.join(shaders.select(F.col("id").alias("shader"), "shader_id"), "shader"), "shader_id", blacklist)


def check_suffix(df: DataFrame, source: str, kind: Column, rules: Mapping[str, Sequence[str]]) -> DataFrame:
    """df with kind and problem: `unknown type`, `bad suffix` or null, by the suffixes that a type allows."""
    fits = F.lit(None).cast("boolean")
    for k, suffixes in rules.items():
        fits = F.when(kind == k, reduce(lambda a, b: a | b, [F.endswith(F.col(source), F.lit(s)) for s in suffixes])).otherwise(fits)
    return df.withColumn("kind", kind).withColumn("problem", F.when(fits.isNull(), "unknown type").when(~fits, "bad suffix"))


def error_number(message: Column, rules=ERROR_RULES, other: int = OTHER) -> Column:
    """0 for null or empty, else the number of the first rule whose text the message has, else `other`."""
    out = F.lit(other)
    for text, number in reversed(rules):
        out = F.when(message.contains(text), number).otherwise(out)
    return F.when(message.isNull() | (message == ""), NONE).otherwise(out)


def short_names(df: DataFrame, col: str, names: Mapping[str, str], out: str = "short") -> DataFrame:
    """Rows whose value is mapped, with the short name."""
    table = df.sparkSession.createDataFrame(list(names.items()), f"`{col}` string, `{out}` string")
    return df.join(F.broadcast(table), col)  # a table as large as the mapping in the program


def describe(*cols: str, short: bool = False) -> Column:
    """Values joined by `-`, or by ` / ` with their names; nulls are left out."""
    if short:
        return F.concat_ws("-", *cols)
    return F.concat_ws(" / ", *[F.concat(F.lit(f"{c}: "), F.col(c).cast("string")) for c in cols])


def restrict_resources(df: DataFrame, resources: DataFrame, predicate: Column, key: str = "resource", keep_null: bool = False) -> DataFrame:
    """Rows whose resource fulfils the predicate, and those without one if `keep_null`."""
    good = resources.where(predicate).select(F.col(key).alias("_k"), F.lit(True).alias("_good")).distinct()
    return df.join(good, F.col(key) == F.col("_k"), "left").where(F.coalesce("_good", F.lit(False)) | (F.col(key).isNull() if keep_null else F.lit(False))).drop("_k", "_good")


def listed_exactly(df: DataFrame, key: str, values: Sequence) -> DataFrame:
    """Rows of the listed keys, each there once; any other number fails the job."""
    got = df.where(F.col(key).isin(list(values)))
    n = got.agg(F.count(F.lit(1)).alias("_n"))
    return got.join(F.broadcast(n)).where(F.when(F.col("_n") == len(values), True).otherwise(F.raise_error(F.lit("not as many rows as keys")).cast("boolean"))).drop("_n")
