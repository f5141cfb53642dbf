"""The world that the driver tables stand for, as SQL both engines read.

Loci are customers, suppliers and parts, and regions, which nothing touches; relationships are orders (customer to
supplier), supplies (supplier to part), shared returns (supplier and supplier,
symmetric) and successions of events (user to user); the change log is the event
stream.  Entities are nations with a yearly history, coheres are regions, facts
are declared supplier preferences.  Every id is arithmetic in its keys, so no
table needs a global sort to be numbered.
"""

from __future__ import annotations

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from ..world import SCHEMAS, World

#: Months from January 1995 of a ship date.
_MONTH = "(year(l_shipdate) - 1995) * 12 + month(l_shipdate) - 1"

LOCI = """
SELECT c_custkey AS locus_id, 1 AS kind, c_acctbal AS s0 FROM customer
UNION ALL SELECT 10000000 + s_suppkey, 2, s_acctbal FROM supplier
UNION ALL SELECT 20000000 + p_partkey, 3, p_retailprice FROM part
UNION ALL SELECT 30000000 + r_regionkey, 4, r_regionkey / 10.0 FROM region
"""

_REL_ID = "CAST({kind} AS BIGINT) * 100000000000000000 + CAST(src AS BIGINT) * 100000000 + CAST(dst AS BIGINT)"

#: Orders, supplies, shared returns, and successions in the event stream.
RELATIONSHIPS = f"""
SELECT {_REL_ID.format(kind=1)} AS rel_id, 1 AS kind, TRUE AS directed, src, dst, activity, weight, change_count, created_batch, last_batch FROM (
  SELECT o_custkey AS src, 10000000 + l_suppkey AS dst, sum(l_quantity) / 100.0 AS activity, avg(l_discount) AS weight, count(*) AS change_count,
         min({_MONTH}) AS created_batch, max({_MONTH}) AS last_batch
  FROM lineitem JOIN orders ON l_orderkey = o_orderkey GROUP BY o_custkey, l_suppkey) k1
UNION ALL
SELECT {_REL_ID.format(kind=2)}, 2, TRUE, src, dst, activity, weight, change_count, created_batch, last_batch FROM (
  SELECT 10000000 + l_suppkey AS src, 20000000 + l_partkey AS dst, sum(l_quantity) / 100.0 AS activity, avg(l_discount) AS weight, count(*) AS change_count,
         min({_MONTH}) AS created_batch, max({_MONTH}) AS last_batch
  FROM lineitem GROUP BY l_suppkey, l_partkey) k2
UNION ALL
SELECT {_REL_ID.format(kind=3)}, 3, FALSE, src, dst, n / 10.0, CASE WHEN same THEN 0.5 ELSE -0.3 END, n, created_batch, last_batch FROM (
  SELECT 10000000 + a.s AS src, 10000000 + b.s AS dst, a.n = b.n AS same, count(*) AS n, min(greatest(a.m, b.m)) AS created_batch, max(greatest(a.m, b.m)) AS last_batch
  FROM (SELECT l_partkey AS p, l_suppkey AS s, s_nationkey AS n, min({_MONTH}) AS m FROM lineitem JOIN supplier ON l_suppkey = s_suppkey WHERE l_returnflag = 'R' GROUP BY l_partkey, l_suppkey, s_nationkey) a
  JOIN (SELECT l_partkey AS p, l_suppkey AS s, s_nationkey AS n, min({_MONTH}) AS m FROM lineitem JOIN supplier ON l_suppkey = s_suppkey WHERE l_returnflag = 'R' GROUP BY l_partkey, l_suppkey, s_nationkey) b
    ON a.p = b.p AND a.s < b.s
  GROUP BY a.s, b.s, a.n = b.n) k3
"""

#: Events in order; predecessors are the user's last event and the hour's last event.
EVENT_CHANGES = """
SELECT event_id AS change_id, user_id AS subject_id,
       CASE event_type WHEN 'view' THEN 1 WHEN 'click' THEN 2 WHEN 'purchase' THEN 3 WHEN 'signup' THEN 4 ELSE 5 END AS kind,
       (month(ts) - 1) * 31 + day(ts) - 1 AS batch,
       lag(event_id) OVER (PARTITION BY user_id ORDER BY event_id) AS own_pred,
       lag(event_id) OVER (PARTITION BY month(ts), day(ts), hour(ts) ORDER BY event_id) AS hour_pred,
       lag(user_id) OVER (PARTITION BY month(ts), day(ts), hour(ts) ORDER BY event_id) AS hour_user,
       lag(value) OVER (PARTITION BY user_id ORDER BY event_id) AS before_value,
       value AS after_value
FROM events
"""

#: A change at one user whose predecessor was another's touches the edge between them.
SUCCESSION_CHANGES = f"""
SELECT 1000000000 + change_id AS change_id, {_REL_ID.format(kind=4)} AS subject_id, kind, batch, change_id AS pred, src, dst, after_value AS a0,
       lag(after_value) OVER (PARTITION BY src, dst ORDER BY change_id) AS b0
FROM (SELECT change_id, kind, batch, after_value, CAST(hour_user AS BIGINT) AS src, CAST(subject_id AS BIGINT) AS dst FROM event_changes WHERE hour_user IS NOT NULL AND hour_user <> subject_id) s
"""

SUCCESSIONS = """
SELECT subject_id AS rel_id, 4 AS kind, TRUE AS directed, src, dst, sum(a0) / 1000.0 AS activity, count(*) / 10.0 AS weight, count(*) AS change_count, min(batch) AS created_batch, max(batch) AS last_batch, min(pred) AS created_by
FROM succession_changes GROUP BY subject_id, src, dst
"""

#: Nations with the customers that ordered in a year: one layer per year.
LAYERS = """
SELECT c_nationkey AS entity_id, year(o_orderdate) - 1992 AS batch, count(DISTINCT c_custkey) AS member_count, round(sum(o_totalprice) / count(*) / 100000.0, 6) AS coherence
FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY c_nationkey, year(o_orderdate)
"""

ENTITIES = """
SELECT c_nationkey AS entity_id, CASE WHEN c_nationkey % 7 = 0 THEN 'Dormant' ELSE 'Active' END AS status, count(*) AS member_count, round(avg(c_acctbal) / 10000.0, 6) AS coherence, min(c_custkey) AS first_member
FROM customer GROUP BY c_nationkey
"""

COHERES = """
SELECT CASE WHEN r_regionkey % 2 = 0 THEN 'default' ELSE 'trade' END AS perspective, r_regionkey AS cohere_id, count(*) AS n_entities, round(count(*) / 25.0, 6) AS strength
FROM region JOIN nation ON n_regionkey = r_regionkey GROUP BY r_regionkey
"""

#: Two declared preferences of every customer, for suppliers found by arithmetic in its key.
_FACT = """SELECT CAST(c_custkey AS BIGINT) * 10 + {place} AS fact_id, c_custkey AS subject, '{predicate}' AS predicate, 10000000 + (c_custkey * {step} + 3) % (SELECT count(*) FROM supplier) AS object,
       c_custkey % 13 AS asserted_at, CASE WHEN c_custkey % 5 = {place} THEN c_custkey % 13 + 4 END AS retracted_at FROM customer"""
FACTS = " UNION ALL ".join(_FACT.format(place=place, predicate=predicate, step=step) for place, predicate, step in ((0, "prefers", 7), (1, "trades_with", 11)))

#: A former relationship of every supplier, pruned since.
PRUNED = """
SELECT CAST(500000000000000000 AS BIGINT) + s_suppkey AS rel_id, s_nationkey + 30 AS batch FROM supplier
"""

#: DuckDB's WITH clause for all of it.
ORACLE_WITH = f"""WITH RECURSIVE loci AS ({LOCI}), rel3 AS ({RELATIONSHIPS}), event_changes AS ({EVENT_CHANGES}), succession_changes AS ({SUCCESSION_CHANGES}), rel4 AS ({SUCCESSIONS}),
rel AS MATERIALIZED (SELECT rel_id, kind, directed, src, dst, activity, weight, change_count, created_batch, last_batch, CAST(NULL AS BIGINT) AS created_by FROM rel3 UNION ALL SELECT rel_id, kind, directed, src, dst, activity, weight, change_count, created_batch, last_batch, created_by FROM rel4),
inc AS (SELECT src AS locus, dst AS other, rel_id, kind, directed, activity, weight, TRUE AS outgoing, (NOT directed OR src = dst) AS incoming FROM rel
        UNION ALL SELECT dst, src, rel_id, kind, directed, activity, weight, NOT directed, TRUE FROM rel WHERE src <> dst),
pred AS (SELECT change_id AS succ, own_pred AS pred FROM event_changes WHERE own_pred IS NOT NULL UNION SELECT change_id, hour_pred FROM event_changes WHERE hour_pred IS NOT NULL UNION SELECT change_id, pred FROM succession_changes),
changes AS (SELECT change_id, 'Locus' AS subject_type, subject_id, kind, batch, before_value AS b0, after_value AS a0 FROM event_changes UNION ALL SELECT change_id, 'Relationship', subject_id, kind, batch, b0, a0 FROM succession_changes),
pruned AS ({PRUNED}), layers AS ({LAYERS}), ents AS ({ENTITIES}), cohs AS ({COHERES}), facts AS ({FACTS})
"""


def project(spark: SparkSession, sf_dir: str) -> World:
    """The world of a folder of driver tables, all lazy."""
    used = ("customer", "supplier", "part", "lineitem", "orders", "events", "nation", "region")
    t = {n: spark.read.parquet(f"{sf_dir}/{n}.parquet") for n in used}

    def sql(text: str, *names: str, **frames):
        for n in names:
            frames[n] = t[n]
        for n in frames:
            text = _named(text, n)
        return spark.sql(text, **frames)

    loci = sql(LOCI, "customer", "supplier", "part", "region").select(F.col("locus_id").cast("bigint"), F.col("kind").cast("bigint"), F.array("s0").alias("state"))
    events = sql(EVENT_CHANGES, "events")
    successions = sql(SUCCESSION_CHANGES, event_changes=events)
    rel4 = sql(SUCCESSIONS, succession_changes=successions)
    shape = ["rel_id", "kind", "directed", "src", "dst", "activity", "weight", "change_count", "created_batch", "last_batch"]
    rel = sql(RELATIONSHIPS, "lineitem", "orders", "supplier").select(*shape, F.lit(None).cast("bigint").alias("created_by")).unionByName(rel4.select(*shape, "created_by"))
    touches = F.struct(F.col("kind").cast("bigint").alias("kind"), F.col("change_count").cast("bigint").alias("touch_count"), F.col("last_batch").cast("bigint").alias("last_batch"))
    relationships = rel.select(
        "rel_id", F.col("kind").cast("bigint").alias("kind"), "directed", F.col("src").cast("bigint").alias("src"), F.col("dst").cast("bigint").alias("dst"),
        F.array(F.col("activity").cast("double"), F.col("weight").cast("double")).alias("state"), F.col("created_by").cast("bigint").alias("created_by"), F.lit(None).cast("bigint").alias("last_touched_by"),
        F.col("change_count").cast("bigint").alias("change_count"), F.array(touches).alias("kinds_observed"), F.col("created_batch").cast("bigint").alias("created_batch"), F.col("last_batch").cast("bigint").alias("last_decayed_batch"), F.lit(None).cast("string").alias("metadata"),
    )

    def change(df, kind: str, preds, before, after):
        return df.select(
            F.col("change_id").cast("bigint").alias("change_id"), F.lit(kind).alias("subject_type"), F.col("subject_id").cast("bigint").alias("subject_id"), F.col("kind").cast("bigint").alias("kind"), preds.alias("predecessors"),
            F.when(F.col(before).isNotNull(), F.array(before)).otherwise(F.array().cast("array<double>")).alias("before"), F.array(after).alias("after"), F.col("batch").cast("bigint").alias("batch"), F.lit(None).cast("bigint").alias("wall_time"), F.lit(None).cast("string").alias("metadata"),
        )

    distinct = F.array_distinct(F.filter(F.array(F.col("own_pred").cast("bigint"), F.col("hour_pred").cast("bigint")), lambda p: p.isNotNull()))
    changes = change(events, "Locus", distinct, "before_value", "after_value").unionAll(change(successions, "Relationship", F.array(F.col("pred").cast("bigint")), "b0", "a0"))

    members = t["customer"].groupBy(F.col("c_nationkey").alias("entity_id")).agg(F.array_sort(F.collect_list(F.col("c_custkey").cast("bigint"))).alias("members"))
    layers = sql(LAYERS, "orders", "customer")
    yearly = (
        t["orders"].join(t["customer"], t["orders"].o_custkey == t["customer"].c_custkey)
        .groupBy(F.col("c_nationkey").alias("entity_id"), (F.year("o_orderdate") - 1992).alias("batch")).agg(F.array_sort(F.collect_set(F.col("c_custkey").cast("bigint"))).alias("members"))
    )
    first = layers.groupBy("entity_id").agg(F.min("batch").alias("__first"))
    empty = F.array().cast("array<bigint>")
    entity_layers = layers.join(first, "entity_id").join(yearly, ["entity_id", "batch"]).select(
        F.col("entity_id").cast("bigint").alias("entity_id"), (F.col("batch") - F.col("__first")).cast("bigint").alias("seq"), F.col("batch").cast("bigint").alias("batch"),
        F.when(F.col("batch") == F.col("__first"), "Born").otherwise("MembershipDelta").alias("transition"), empty.alias("added"), empty.alias("removed"), empty.alias("offspring"), empty.alias("absorbed"),
        F.lit(None).cast("double").alias("coh_from"), F.lit(None).cast("double").alias("coh_to"), F.when(F.col("entity_id") % 4 == 0, "Compressed").otherwise("Full").alias("compression"), F.col("coherence").cast("double").alias("coherence"), F.col("member_count").cast("bigint").alias("member_count"),
        "members", empty.alias("member_rels"), F.struct(F.lit("ComponentMatch").alias("type"), empty.alias("rels"), empty.alias("entities")).alias("cause"),
    )
    entities = sql(ENTITIES, "customer").join(members, "entity_id").select(F.col("entity_id").cast("bigint").alias("entity_id"), "status", "members", empty.alias("member_rels"), F.col("coherence").cast("double").alias("coherence"), empty.alias("parents"), empty.alias("children"))
    nations = t["nation"].groupBy(F.col("n_regionkey").alias("cohere_id")).agg(F.array_sort(F.collect_list(F.col("n_nationkey").cast("bigint"))).alias("entity_ids"))
    coheres = sql(COHERES, "region", "nation").join(nations, "cohere_id").select("perspective", F.lit(0).cast("bigint").alias("batch"), F.col("cohere_id").cast("bigint").alias("cohere_id"), "entity_ids", empty.alias("relationship_ids"), F.col("strength").cast("double").alias("strength"))
    facts = sql(FACTS, "customer", "supplier").select(*[F.col(c).cast("bigint") if c != "predicate" else F.col(c) for c in ("fact_id", "subject", "predicate", "object", "asserted_at", "retracted_at")])
    properties = t["customer"].select(F.col("c_custkey").cast("bigint").alias("locus_id"), F.to_json(F.struct(F.col("c_mktsegment").alias("segment"), F.col("c_acctbal").alias("balance"))).alias("props"))
    names = t["customer"].select(F.col("c_name").alias("name"), F.col("c_custkey").cast("bigint").alias("locus_id"), F.lit(False).alias("is_alias")).unionAll(
        t["supplier"].select("s_name", (F.col("s_suppkey") + 10000000).cast("bigint"), F.lit(False))
    )
    pruned = sql(PRUNED, "supplier").select("rel_id", F.col("batch").cast("bigint").alias("batch"))
    given = dict(pruned_log=pruned, loci=loci, relationships=relationships, changes=changes, entities=entities, entity_layers=entity_layers, coheres=coheres, facts=facts, properties=properties, names=names)
    assert set(given) <= set(SCHEMAS)
    return World.of(spark, current_batch=84, **given)


def _named(text: str, name: str) -> str:
    """Table ``name`` in a FROM or JOIN becomes the ``{name}`` of a parametrised query."""
    import re

    return re.sub(rf"\b(FROM|JOIN) {name}\b", rf"\1 {{{name}}}", text)
