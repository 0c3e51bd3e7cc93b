"""Timelines around anchor events and the factual reports over them."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

from ..functions.rules import bucket_from_anchor, phase_of
from ..functions.times import seconds_between, slot_of
from ..schemas import FORBIDDEN_KEYS, guard_keys
from ..session import cut_lineage
from .stats import describe


def _in_order() -> WindowSpec:
    return Window.partitionBy("timeline_id").orderBy("idx")


# -- building -----------------------------------------------------------------------------
def reconstruct(
    anchors: DataFrame, facts: DataFrame, by: Sequence[str], *,
    pre_seconds: int = 30 * 60, post_seconds: int = 120 * 60, phase_unit: str = "minute",
) -> DataFrame:
    """Timeline events for many anchors at once.

    `anchors`: timeline_id, anchor_ts, anchor_kind and the `by` columns; `facts`: the `by`
    columns, ts, kind, detail. Facts are found once per group, not once per anchor. The
    range join carries a time slot as an equality key, so an anchor meets only facts of the
    two or three slots its window touches, and a hot group is spread over its slots. The
    anchor row itself is always kept.
    """
    width = pre_seconds + post_seconds
    pre = F.make_dt_interval(secs=F.lit(pre_seconds))
    post = F.make_dt_interval(secs=F.lit(post_seconds))
    head = ["timeline_id", "symbol", "anchor_ts"]
    lo, hi = F.col("anchor_ts") - pre, F.col("anchor_ts") + post
    asked = anchors.select(
        "timeline_id", "anchor_ts", *by,
        F.explode(F.sequence(slot_of(lo, width), slot_of(hi, width))).alias("_slot"))
    near = (
        asked.join(facts.withColumn("_slot", slot_of(F.col("ts"), width)), [*by, "_slot"])
        .where((F.col("ts") >= lo) & (F.col("ts") <= hi))
        .select(*head, "ts", "kind", phase_of(F.col("ts"), F.col("anchor_ts"), phase_unit).alias("phase"),
                "detail", F.lit(1).alias("_src"))
    )
    own = anchors.select(
        *head, F.col("anchor_ts").alias("ts"), F.col("anchor_kind").alias("kind"), F.lit("AT").alias("phase"),
        F.create_map().cast("map<string,double>").alias("detail"), F.lit(0).alias("_src"))
    order = Window.partitionBy("timeline_id").orderBy("ts", "kind", "_src", F.to_json("detail"))
    return near.unionByName(own).withColumn("idx", F.row_number().over(order) - 1).select(
        *head, "idx", "ts", "kind", "phase", "detail")


def guard_details(events: DataFrame) -> DataFrame:
    """Make any job over `events` fail when a detail key is not a fact."""
    bad = F.arrays_overlap(F.map_keys("detail"), F.array(*[F.lit(k) for k in FORBIDDEN_KEYS]))
    checked = F.when(F.coalesce(bad, F.lit(False)), F.raise_error(F.lit("detail holds a forbidden key")).cast("int"))
    return events.where(checked.isNull())


# -- counts ---------------------------------------------------------------------------------
def kind_frequency(events: DataFrame) -> DataFrame:
    return events.groupBy("kind").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "kind")


def phase_distribution(events: DataFrame) -> DataFrame:
    return events.groupBy("phase").agg(F.count("*").alias("n"))


def events_per_timeline(events: DataFrame) -> DataFrame:
    sizes = events.groupBy("timeline_id").agg(F.count("*").alias("n_events"))
    return describe(cut_lineage(sizes), [], "n_events")


def gap_seconds(events: DataFrame) -> DataFrame:
    gap = seconds_between(F.col("ts"), F.lag("ts").over(_in_order()))
    return events.select("timeline_id", "idx", gap.alias("gap")).where(F.col("gap").isNotNull())


def inter_event_gap(events: DataFrame) -> DataFrame:
    return describe(cut_lineage(gap_seconds(events)), [], "gap")


def time_to_first_kind(events: DataFrame, kind: str) -> DataFrame:
    """Minutes from the anchor to the first POST event of a kind, over timelines that have one."""
    first = events.where((F.col("kind") == kind) & (F.col("phase") == "POST")).groupBy("timeline_id").agg(
        F.min(seconds_between(F.col("ts"), F.col("anchor_ts")) / 60.0).alias("minutes"))
    return describe(cut_lineage(first), [], "minutes")


def kind_pairs(events: DataFrame) -> DataFrame:
    """Counts of consecutive kinds."""
    nxt = events.select("kind", F.lead("kind").over(_in_order()).alias("_next")).where(F.col("_next").isNotNull())
    return nxt.groupBy(F.concat_ws("->", "kind", "_next").alias("pair")).agg(
        F.count("*").alias("n")).orderBy(F.desc("n"), "pair")


# -- archetypes -------------------------------------------------------------------------------
def archetype_key(scheme: str) -> Column:
    """Aggregate that turns the events of one timeline into a structural key; nothing is scored."""
    kind, post = F.col("kind"), F.when(F.col("phase") == "POST", F.col("kind"))

    def as_set(values: Column) -> Column:
        return F.array_join(F.sort_array(F.collect_set(values)), "|")

    def in_sequence(values: Column) -> Column:
        rows = F.sort_array(F.collect_list(F.struct("idx", values.alias("k"))))
        return F.array_join(F.transform(rows, lambda x: x["k"]), ">")

    # The names of the key forms.
    keys = {"phase_kind_seq": in_sequence(F.concat_ws(":", "phase", "kind")), "kind_seq": in_sequence(kind),
            "kind_set": as_set(kind), "post_kind_set": as_set(post)}
    if scheme not in keys:
        raise ValueError(f"there is no archetype key {scheme!r}, only {', '.join(keys)}")
    return keys[scheme]


def archetypes(events: DataFrame, scheme: str = "kind_set") -> DataFrame:
    """(timeline_id, n_events, archetype)."""
    return events.groupBy("timeline_id").agg(F.count("*").alias("n_events"), archetype_key(scheme).alias("archetype"))


def family_sizes(events: DataFrame, scheme: str = "kind_set") -> DataFrame:
    return archetypes(events, scheme).groupBy("archetype").agg(
        F.count("*").alias("n")).orderBy(F.desc("n"), "archetype")


def index_rows(events: DataFrame, scheme: str) -> DataFrame:
    """Rows of the archetype index: append them to a table keyed by (timeline_id, scheme)."""
    who = events.groupBy("timeline_id").agg(F.first("symbol").alias("symbol"), F.first("anchor_ts").alias("anchor_ts"))
    return archetypes(events, scheme).join(who, "timeline_id").select(
        "timeline_id", "symbol", "anchor_ts", F.lit(scheme).alias("scheme"), "archetype", "n_events")


def index_members(index: DataFrame, scheme: str, archetype: str) -> DataFrame:
    return index.where((F.col("scheme") == scheme) & (F.col("archetype") == archetype)).orderBy("anchor_ts", "timeline_id")


def index_families(index: DataFrame, scheme: str) -> DataFrame:
    return index.where(F.col("scheme") == scheme).groupBy("archetype").agg(
        F.count("*").alias("n")).orderBy(F.desc("n"), "archetype")


# -- relations --------------------------------------------------------------------------------
def follows(events: DataFrame) -> DataFrame:
    nxt = events.select("timeline_id", F.col("idx").alias("src"), F.lead("idx").over(_in_order()).alias("dst"),
                        "ts", F.lead("ts").over(_in_order()).alias("_nts"))
    return nxt.where(F.col("dst").isNotNull()).select(
        "timeline_id", "src", "dst", F.lit("FOLLOWS").alias("relation"),
        seconds_between(F.col("_nts"), F.col("ts")).alias("delta_seconds"))


def graph_edges(events: DataFrame, within_seconds: int = 300, same_unit: str = "minute") -> DataFrame:
    """FOLLOWS, SAME_MINUTE and WITHIN edges inside each timeline.

    An event meets only events of its own and the next slot of `within` width, so far pairs
    of a long timeline are never formed. Slots start at whole units, so a shared unit never
    spans more than two slots.
    """
    e = events.select("timeline_id", "idx", "ts", slot_of(F.col("ts"), within_seconds).alias("_slot"))
    a = e.select("timeline_id", F.col("idx").alias("src"), F.col("ts").alias("_a"),
                 F.explode(F.array("_slot", F.col("_slot") + 1)).alias("_slot"))
    b = e.select("timeline_id", F.col("idx").alias("dst"), F.col("ts").alias("_b"), "_slot")
    delta = seconds_between(F.col("_b"), F.col("_a"))
    same = F.date_trunc(same_unit, "_a") == F.date_trunc(same_unit, "_b")
    label = f"WITHIN_{within_seconds // 60}M"
    relation = F.when(same, f"SAME_{same_unit.upper()}").when((delta > 0) & (delta <= within_seconds), label)
    pairs = a.join(b, ["timeline_id", "_slot"]).where(F.col("dst") > F.col("src")).select(
        "timeline_id", "src", "dst", relation.alias("relation"), delta.alias("delta_seconds"))
    return follows(events).unionByName(pairs.where(F.col("relation").isNotNull()))


# -- views --------------------------------------------------------------------------------------
def heatmap(events: DataFrame, bucket_minutes: int = 5) -> DataFrame:
    """Count per kind and minutes-from-anchor bucket, zero-filled over all observed kinds and buckets."""
    minutes = seconds_between(F.col("ts"), F.col("anchor_ts")) / 60.0
    cells = events.select("kind", bucket_from_anchor(minutes, bucket_minutes).alias("bucket")).groupBy(
        "kind", "bucket").agg(F.count("*").alias("n"))
    # The axes are the distinct kinds and the distinct buckets of a fixed window.
    axis = cells.agg(F.sort_array(F.collect_set("kind")).alias("_k"), F.sort_array(F.collect_set("bucket")).alias("_b"))
    grid = axis.select(F.explode("_k").alias("kind"), "_b").select("kind", F.explode("_b").alias("bucket"))
    return grid.join(cells, ["kind", "bucket"], "left").select(
        "kind", "bucket", F.coalesce("n", F.lit(0)).cast("bigint").alias("n"))


def event_tree(events: DataFrame) -> DataFrame:
    """Per timeline: phase, kind, count and the ordered clock times."""
    return events.groupBy("timeline_id", "phase", "kind").agg(
        F.count("*").alias("n"),
        F.sort_array(F.collect_list(F.date_format("ts", "HH:mm:ss"))).alias("times"))


def nested(events: DataFrame) -> DataFrame:
    """One row per timeline with its events as an ordered array, as written to JSON."""
    item = F.struct("idx", "ts", "kind", "phase", "detail")
    return events.groupBy("timeline_id", "symbol", "anchor_ts").agg(
        F.sort_array(F.collect_list(F.struct("idx", F.to_json(item).alias("j")))).alias("_e")
    ).select("timeline_id", "symbol", "anchor_ts", F.transform("_e", lambda x: x["j"]).alias("events"))


def summary(events: DataFrame) -> DataFrame:
    """Long form (section, metric, value) of the counts and descriptions above."""
    events = cut_lineage(events)

    def long(df: DataFrame, section: str) -> DataFrame:
        cols = df.columns
        pairs = F.array(*[F.struct(F.lit(c).alias("metric"), F.col(c).cast("double").alias("value")) for c in cols])
        return df.select(F.lit(section).alias("section"), F.inline(pairs))

    total = events.agg(F.count_distinct("timeline_id").cast("double").alias("value")).select(
        F.lit("timelines").alias("section"), F.lit("count").alias("metric"), "value")
    kinds = events.groupBy("kind").agg(F.count("*").cast("double").alias("value")).select(
        F.lit("kind_frequency").alias("section"), F.col("kind").alias("metric"), "value")
    phases = events.groupBy("phase").agg(F.count("*").cast("double").alias("value")).select(
        F.lit("phase_distribution").alias("section"), F.col("phase").alias("metric"), "value")
    return (total.unionByName(kinds).unionByName(phases)
            .unionByName(long(events_per_timeline(events), "events_per_timeline"))
            .unionByName(long(inter_event_gap(events), "inter_event_gap_seconds")))


# -- search ---------------------------------------------------------------------------------------
def fact(key: str) -> Column:
    """A detail value for predicates on events; NULL where the key is absent, so that no comparison holds."""
    guard_keys([key])
    return F.try_element_at(F.col("detail"), F.lit(key))


def timelines_where(events: DataFrame, *conditions: Column) -> DataFrame:
    """Ids of the timelines whose events, taken together, meet every condition.

    Conditions are boolean aggregates over the events of one timeline (counts, `bool_or`, `archetype_key(...) == ...`);
    all of them are computed in one grouping. Filter `events` first to look at part of them only.
    """
    met = F.lit(True)
    for c in conditions:
        met = met & F.coalesce(c, F.lit(False))
    return events.groupBy("timeline_id").agg(met.alias("_met")).where("_met").select("timeline_id")
