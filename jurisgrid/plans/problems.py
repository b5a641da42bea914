"""Queries of the general data problems (p1, p3, p4) and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from jurisgrid.common import cut, id_key, latest, table
from jurisgrid.operators.hierarchy import build_nodes, descendant_pairs, peel, resolve_hierarchy
from jurisgrid.operators.orphans import find_orphans, orphan_report, period_of
from jurisgrid.operators.timestamps import normalise_timestamps


def _dated(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(record_id, field_name, value, zone_name, numeric_order), one row for each record and field."""
    fiches = latest(table(spark, sf_dir, "fiches").select("fiche_id", "feed_code", "judgment_date", "adoption_date", "loaded_at").where("fiche_id is not null"), ["fiche_id"], "loaded_at")
    ids = latest(table(spark, sf_dir, "identities").select("identity_id", "feed_code", "identity_date", "loaded_at").where("identity_id is not null"), ["identity_id"], "loaded_at")
    long = fiches.select(
        F.col("fiche_id").alias("record_id"), "feed_code",
        F.explode(F.array(*[F.struct(F.lit(c).alias("field_name"), F.col(c).alias("value")) for c in ("judgment_date", "adoption_date")])).alias("f"),
    ).select("record_id", "feed_code", "f.field_name", "f.value")
    long = long.unionByName(ids.select(F.col("identity_id").alias("record_id"), "feed_code", F.lit("identity_date").alias("field_name"), F.col("identity_date").alias("value")))
    feeds = table(spark, sf_dir, "intake_feeds").groupBy("feed_code").agg(F.min("zone_name").alias("zone_name"), F.min("numeric_order").alias("numeric_order"))
    return long.where("value is not null").join(feeds, "feed_code", "left")


def p1_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = normalise_timestamps(_dated(spark, sf_dir), "value", "zone_name", "numeric_order")
    return out.where("ts.utc_value is not null").select("record_id", "field_name", F.col("ts.utc_value").alias("utc_value"))


def p1_kinds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How the values of each field came out."""
    out = normalise_timestamps(_dated(spark, sf_dir), "value", "zone_name", "numeric_order")
    return out.groupBy("field_name", F.col("ts.kind").alias("kind"), F.col("ts.zone_source").alias("zone_source")).agg(F.count(F.lit(1)).alias("n"))


def _provisions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return latest(table(spark, sf_dir, "provisions").select("provision_id", "fiche_id", "canonical_id", "parent_id", "loaded_at"), ["provision_id"], "loaded_at")


def p3_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    elements = table(spark, sf_dir, "elements").select("fiche_id", "canonical_id")
    nodes = cut(build_nodes(_provisions(spark, sf_dir), elements, "fiche_id", "canonical_id", "parent_id"))
    return nodes.join(peel(nodes), ["grp", "key"]).select(F.col("grp").alias("fiche_id"), F.col("id").alias("canonical_id"), "cycle_id")


def p3_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _hierarchy(spark, sf_dir).drop("way")


def _hierarchy(spark: SparkSession, sf_dir: str) -> DataFrame:
    return resolve_hierarchy(_provisions(spark, sf_dir), table(spark, sf_dir, "elements").select("fiche_id", "canonical_id"))


def p3_descendants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return descendant_pairs(_hierarchy(spark, sf_dir))


def _references(spark: SparkSession, sf_dir: str) -> DataFrame:
    sides = []
    for name, rid, target in (("cross_references", "ref_id", "target_canonical_id"), ("relationships", "rel_id", "target_id")):
        rows = latest(table(spark, sf_dir, name).select(rid, "fiche_id", target, "created_at", "loaded_at").where(F.col(rid).isNotNull()), [rid], "loaded_at")
        sides.append(rows.select(F.lit(name).alias("table_name"), F.col(rid).alias("record_id"), "fiche_id", id_key(F.col(target)).alias("target"), "created_at"))
    return sides[0].unionByName(sides[1])


def _parents(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "elements").select("fiche_id", id_key(F.col("canonical_id")).alias("target"), "loaded_at", "deleted_at")
    return e.groupBy("fiche_id", "target").agg(F.min("loaded_at").alias("first_loaded"), F.max(F.col("deleted_at").isNotNull()).alias("deleted"))


def p4_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return find_orphans(_references(spark, sf_dir), _parents(spark, sf_dir), ["fiche_id", "target"])


def p4_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    refs = _references(spark, sf_dir)
    return orphan_report(find_orphans(refs, _parents(spark, sf_dir), ["fiche_id", "target"]), refs.where("target is not null").withColumn("period", period_of(F.col("created_at"))))


_KEY = "nullif(lower(trim({})), '')"
_NODES = f"""
own as (select fiche_id as grp, {_KEY.format("canonical_id")} as key, min(trim(canonical_id)) as id, min({_KEY.format("parent_id")}) as up
        from (select *, row_number() over (partition by provision_id order by loaded_at desc) as rn from provisions) where rn = 1 and canonical_id is not null group by 1, 2),
el as (select distinct fiche_id as grp, {_KEY.format("canonical_id")} as key from elements),
ids as (select fiche_id as grp, {_KEY.format("canonical_id")} as key, min(trim(canonical_id)) as id from (select fiche_id, canonical_id from elements union all select fiche_id, canonical_id from provisions) group by 1, 2),
nodes as (select o.grp, o.key, o.id, case when i.key is not null then o.up end as parent, false as implicit from own o left join ids i on o.grp = i.grp and o.up = i.key),
alln as (select * from nodes union all
         select distinct n.grp, n.parent, i.id, null, true from nodes n join ids i on i.grp = n.grp and i.key = n.parent where not exists (select 1 from own o where o.grp = n.grp and o.key = n.parent))"""
_CYCLES = """
walk as (select grp, key, parent as at, 1 as step from alln where parent is not null
         union all select w.grp, w.key, n.parent, w.step + 1 from walk w join alln n on n.grp = w.grp and n.key = w.at
         where n.parent is not null and w.step <= 2 * (select max(c) from (select count(*) as c from alln group by grp))),
endless as (select grp, key from walk where step = 2 * (select max(c) from (select count(*) as c from alln group by grp)) group by 1, 2),
loopwalk as (select w.grp, w.key, min(n.id) as cycle_id from walk w join endless e on e.grp = w.grp and e.key = w.key join alln n on n.grp = w.grp and n.key = w.at
             where w.step > (select max(c) from (select count(*) as c from alln group by grp)) group by 1, 2)"""

QUERIES = {"p1_found": p1_found, "p1_kinds": p1_kinds, "p3_found": p3_found, "p3_tree": p3_tree, "p3_descendants": p3_descendants, "p4_found": p4_found, "p4_report": p4_report}

_TREE = f"""with recursive {_NODES.strip()},{_CYCLES},
heads as (select l.grp, l.key, l.cycle_id from loopwalk l join alln n on n.grp = l.grp and n.key = l.key and n.id = l.cycle_id),
forest as (select a.grp, a.key, a.id, case when h.key is null then a.parent end as parent, a.implicit from alln a left join heads h on h.grp = a.grp and h.key = a.key),
down as (select grp, key, id, parent, implicit, id as root, id as path, 0::bigint as depth, [key] as way from forest where parent is null
         union all select f.grp, f.key, f.id, f.parent, f.implicit, d.root, d.path || '/' || f.id, d.depth + 1, list_append(d.way, f.key) from down d join forest f on f.grp = d.grp and f.parent = d.key)"""
_ORPHANS = f"""with refs as (
  select 'cross_references' as table_name, ref_id as record_id, fiche_id, {_KEY.format("target_canonical_id")} as target, created_at from (select *, row_number() over (partition by ref_id order by loaded_at desc) as rn from cross_references) where rn = 1
  union all select 'relationships', rel_id, fiche_id, {_KEY.format("target_id")}, created_at from (select *, row_number() over (partition by rel_id order by loaded_at desc) as rn from relationships) where rn = 1),
el as (select fiche_id, {_KEY.format("canonical_id")} as target, min(loaded_at) as first_loaded, max(case when deleted_at is not null then 1 else 0 end) as deleted from elements group by 1, 2),
j as (select r.*, strftime(created_at at time zone 'UTC', '%Y-%m') as period, case when e.target is null then 'missing' when deleted = 1 then 'deleted' when first_loaded > created_at then 'late' end as state
      from refs r left join el e on e.fiche_id = r.fiche_id and e.target = r.target where r.target is not null and r.fiche_id is not null)"""
SQL = {
    "p3_found": f"with recursive {_NODES.strip()},{_CYCLES} select l.grp as fiche_id, n.id as canonical_id, l.cycle_id from loopwalk l join alln n on n.grp = l.grp and n.key = l.key",
    "p3_tree": f"""{_TREE},
      size as (select grp, unnest(way) as key, count(*) - 1 as descendants from down group by 1, 2),
      pre as (select d.*, s.descendants, (row_number() over (partition by d.grp, d.way[1] order by d.way) - 1) as pos from down d join size s on s.grp = d.grp and s.key = d.key)
      select p.grp as fiche_id, p.id as canonical_id, u.id as parent_id, p.root, p.path, p.depth, 2 * pos - p.depth as entry, 2 * pos - p.depth + 2 * p.descendants + 1 as exit, p.descendants, l.cycle_id, p.implicit
      from pre p left join loopwalk l on l.grp = p.grp and l.key = p.key left join alln u on u.grp = p.grp and u.key = p.parent""",
    "p3_descendants": f"{_TREE} select d.grp as fiche_id, n.id as ancestor, d.id as descendant, d.depth - n.depth as distance from down d join down n on n.grp = d.grp and list_contains(d.way, n.key) and n.depth < d.depth and n.way[1] = d.way[1]",
    "p4_found": f"{_ORPHANS} select table_name, record_id, period, state from j where state is not null",
    "p4_report": f"{_ORPHANS}, t as (select table_name, period, count(*) as refs from j group by 1, 2) select j.table_name, j.period, j.state, count(*) as orphans, min(t.refs) as refs from j join t on t.table_name = j.table_name and t.period = j.period where state is not null group by 1, 2, 3",
}
