"""State machines over event logs, admission of definitions, pre-registration."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import cut_lineage
from .slots import first_rows, with_number

# Allowed moves; a state without moves is terminal.
FEATURE_MOVES = {
    "OBSERVATION": ("TESTING", "REJECTED"),
    "TESTING": ("PROVISIONAL", "REJECTED"),
    "PROVISIONAL": ("CONFIRMED", "REJECTED"),
    "CONFIRMED": (),
    "REJECTED": (),
}
HYPOTHESIS_MOVES = {
    "REGISTERED": ("TESTING", "REJECTED"),
    "TESTING": ("OOS_PASS", "OOS_FAIL", "REJECTED"),
    "OOS_PASS": ("VAULT_PASS", "VAULT_FAIL", "REJECTED"),
    "OOS_FAIL": ("REJECTED",),
    "VAULT_PASS": ("CONFIRMED", "REJECTED"),
    "VAULT_FAIL": ("REJECTED",),
    "CONFIRMED": (),
    "REJECTED": (),
}
FEATURE_CLASSES = ("PRICE_STATE", "LIQUIDITY_STATE", "LIQUIDITY_SHOCK", "SESSION_STATE", "CROSS_MARKET", "SEQUENCE_STATE",
                   "EXECUTION_STATE", "CUSTOM")
REQUIRED_FEATURE_FIELDS = ("feature_id", "name", "version", "formula_ref", "pit_proof", "economic_rationale")
CHUNK_EVENTS = 1024
#: Transfer maps composed at once.
FAN = 64


def _move(moves: dict[str, tuple[str, ...]], state: Column, to: Column) -> Column:
    """Next state: `to` when allowed, else unchanged."""
    legal = F.lit(False)
    for source, targets in moves.items():
        if targets:
            legal = legal | ((state == source) & to.isin(*targets))
    return F.when(legal, to).otherwise(state)


def replay(events: DataFrame, by: Sequence[str], moves: dict[str, tuple[str, ...]], initial: str,
           chunk_events: int = CHUNK_EVENTS) -> DataFrame:
    """Judge every event (by..., seq, to_state): adds `from_state` and `legal`.

    Illegal moves leave the state as it is. A log may be long for one entity, so its events are
    numbered densely and cut into chunks. Each chunk is summarised as a transfer map, "end state
    for every possible start state". Maps are composed FAN at a time, level by level, up to one per
    entity; going down again, every level learns its start states, and each chunk is replayed on its
    own. No array holds more than a chunk's events or FAN maps.
    """
    by = list(by)
    states = list(moves)
    names = F.array(*[F.lit(s) for s in states])
    numbered = with_number(events.select(*by, "seq", "to_state"), by, ["seq", "to_state"], "_n")
    chunks = cut_lineage(numbered.groupBy(*by, F.floor(F.col("_n") / chunk_events).alias("_chunk")).agg(
        F.sort_array(F.collect_list(F.struct("seq", "to_state"))).alias("_items")))

    def jump(state: Column, ends: Column) -> Column:
        return F.element_at(ends, F.array_position(names, state).cast("int"))

    def composed(items: str, step: Callable[[Column, Column], Column]) -> Column:
        return F.array(*[F.aggregate(items, F.lit(s), step) for s in states])

    level = chunks.select(*by, "_chunk", composed("_items", lambda acc, e: _move(moves, acc, e["to_state"])).alias("_ends"))
    most, parents = chunks.agg(F.max("_chunk")).first()[0] or 0, []
    while most > 0:
        level = cut_lineage(
            level.groupBy(*by, F.floor(F.col("_chunk") / FAN).alias("_parent"))
            .agg(F.sort_array(F.collect_list(F.struct("_chunk", "_ends"))).alias("_links"))
            .select(*by, F.col("_parent").alias("_chunk"), "_links",
                    composed("_links", lambda acc, link: jump(acc, link["_ends"])).alias("_ends")))
        parents.append(level)
        most //= FAN

    zero = F.expr("cast(array() as array<struct<_chunk:bigint,_start:string>>)")

    def chain(acc: Column, link: Column) -> Column:
        start = F.struct(link["_chunk"].alias("_chunk"), acc["state"].alias("_start"))
        return F.struct(jump(acc["state"], link["_ends"]).alias("state"), F.concat(acc["starts"], F.array(start)).alias("starts"))

    starts = None
    for links in reversed(parents):
        known = links.withColumn("_start", F.lit(initial)) if starts is None else links.join(starts, [*by, "_chunk"])
        begin = F.struct(F.col("_start").alias("state"), zero.alias("starts"))
        starts = known.select(*by, F.inline(F.aggregate("_links", begin, chain)["starts"]))

    def judge(acc: Column, e: Column) -> Column:
        nxt = _move(moves, acc["state"], e["to_state"])
        row = F.struct(e["seq"].cast("bigint").alias("seq"), e["to_state"].alias("to_state"),
                       acc["state"].alias("from_state"), (nxt != acc["state"]).alias("legal"))
        return F.struct(nxt.alias("state"), F.concat(acc["out"], F.array(row)).alias("out"))

    begin = F.struct(
        F.col("_start").alias("state"),
        F.expr("cast(array() as array<struct<seq:bigint,to_state:string,from_state:string,legal:boolean>>)").alias("out"))
    started = chunks.withColumn("_start", F.lit(initial)) if starts is None else chunks.join(starts, [*by, "_chunk"])
    return started.select(*by, F.inline(F.aggregate("_items", begin, judge)["out"]))


def current_states(events: DataFrame, by: Sequence[str], moves: dict[str, tuple[str, ...]], initial: str) -> DataFrame:
    """Final state and number of refused moves per entity."""
    judged = replay(events, by, moves, initial)
    last = F.max_by(F.when(F.col("legal"), F.col("to_state")).otherwise(F.col("from_state")), F.col("seq"))
    return judged.groupBy(*by).agg(last.alias("state"), F.sum((~F.col("legal")).cast("bigint")).alias("refused"))


# -- features ---------------------------------------------------------------------------------
def admit_features(defs: DataFrame, gate_runs: DataFrame, stored: DataFrame | None = None,
                   classes: Sequence[str] = FEATURE_CLASSES) -> DataFrame:
    """Add `reject_code` (NULL = admitted) and `reject_about` (the field or value at fault) of the first failing rule.

    `gate_runs` holds (pit_run_id, verdict). Of several admissible rows for one (id, version)
    only the first by seq is admitted.
    """
    verdicts = gate_runs.select(F.col("pit_run_id").alias("pit_proof"), F.col("verdict").alias("_verdict"))
    rows = defs.join(verdicts, "pit_proof", "left")
    kind, none = F.col("feature_class"), F.lit("")

    def refuse(code: str, about: Column) -> Column:
        return F.struct(F.lit(code).alias("code"), about.alias("about"))

    rules = [(F.coalesce(F.col(c), none) == "", "EMPTY_FIELD", F.lit(c)) for c in REQUIRED_FEATURE_FIELDS] + [
        (~F.coalesce(kind.isin(*classes), F.lit(False)), "CLASS", F.coalesce(kind, none)),
        (F.coalesce(F.col("lookback_window"), F.lit(-1)) < 0, "LOOKBACK", F.coalesce(F.col("lookback_window").cast("string"), none)),
        (F.col("_verdict").isNull(), "NO_PROOF", F.col("pit_proof")),
        (F.col("_verdict") != "PASS", "PROOF", F.col("_verdict")),
        (kind == "EXECUTION_STATE", "OUTCOME_SIDE", kind),
        ((kind == "SEQUENCE_STATE") & ~F.coalesce(F.col("cross_row_dependent"), F.lit(False)), "NOT_CROSS_ROW", kind)]
    reason = F.coalesce(*[F.when(broken, refuse(code, about)) for broken, code, about in rules])
    judged = rows.withColumns({"reject_code": reason["code"], "reject_about": reason["about"]}).drop("_verdict")
    key = ["feature_id", "version"]
    fit = judged.where(F.col("reject_code").isNull())
    first = fit.groupBy(*key).agg(F.min("seq").alias("_first"))
    out = judged.join(first, key, "left")
    taken = F.col("_first").isNotNull() & (F.col("seq") != F.col("_first"))
    if stored is not None:
        out = out.join(stored.select(*key).distinct().withColumn("_held", F.lit(True)), key, "left")
        taken = taken | F.col("_held").isNotNull()
    late = F.col("reject_code").isNull() & taken
    return out.select(*defs.columns, F.when(late, "TAKEN").otherwise(F.col("reject_code")).alias("reject_code"),
                      F.when(late, F.col("version")).otherwise(F.col("reject_about")).alias("reject_about"))


# -- hypotheses -------------------------------------------------------------------------------
def register_hypotheses(incoming: DataFrame, stored: DataFrame | None = None) -> DataFrame:
    """Add `reject_code`: INCOMPLETE without a statement, a predicted effect and a test spec; TAKEN for a used id."""
    incomplete = F.lit(False)
    for c in ("statement", "predicted_effect", "frozen_test_spec"):
        incomplete = incomplete | (F.coalesce(F.col(c), F.lit("")) == "")
    rows = incoming.withColumn("_incomplete", incomplete)
    first = first_rows(rows.where(~F.col("_incomplete")), ["hypothesis_id"], ["seq"], 1).select(
        "hypothesis_id", F.col("seq").alias("_first"))
    out = rows.join(first, "hypothesis_id", "left")
    again = F.col("seq") != F.col("_first")
    if stored is not None:
        out = out.join(stored.select("hypothesis_id").distinct().withColumn("_held", F.lit(True)), "hypothesis_id", "left")
        again = again | F.col("_held").isNotNull()
    code = F.when(F.col("_incomplete"), "INCOMPLETE").when(again, "TAKEN")
    return out.select(*incoming.columns, code.alias("reject_code"))


def loggable_experiments(experiments: DataFrame, hypotheses: DataFrame) -> DataFrame:
    return experiments.join(hypotheses.select("hypothesis_id"), "hypothesis_id", "left_semi")


def orphan_experiments(experiments: DataFrame, hypotheses: DataFrame) -> DataFrame:
    return experiments.join(hypotheses.select("hypothesis_id"), "hypothesis_id", "left_anti")


def family_size(experiments: DataFrame) -> DataFrame:
    """Distinct hypotheses ever run on OOS or VAULT data, whatever became of them."""
    tested = experiments.where(F.upper("dataset").isin("OOS", "VAULT"))
    return tested.select("hypothesis_id").distinct().agg(F.count("*").alias("family_size"))
