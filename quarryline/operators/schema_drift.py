"""Schemas that drift between the files of one artifact.

Every artifact gets a fingerprint of its fields and their types. Consecutive versions with different fingerprints yield
migration steps: ``renamed``, ``retyped``, ``added`` or ``removed``. A record is routed through the chain of steps that
lies between its own version and the last one: renames give each field its canonical name, retypes cast it to the last
type, fields that are missing get the default null. A cast that fails leaves null and is marked.

Payloads are parsed once, into cells, which every later step reads from a checkpoint.

Defined results: null, unreadable and non-object payloads carry no fields; repeated lines count once; a field with only
nulls exists but has no type, so it is never retyped; an empty table gives no rows; further columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quarryline.session import checkpointed

#: The names of the types of JSON values.
TYPE_NAMES = {"STRING": "string", "BOOLEAN": "boolean", "BIGINT": "number", "DOUBLE": "number", "FLOAT": "number"}
#: Versions in one block of the two-level search for the previous version.
BLOCK = 256


def ordered_artifacts(artifacts: DataFrame) -> DataFrame:
    """One row per artifact with the artifact before it: (artifact_id, snapshot_id, kind, version, prev_id).

    The search goes within blocks of versions first and then over one row per block, so a snapshot and kind with a
    large share of all artifacts is not sorted in one task.
    """
    one = artifacts.where("artifact_id is not null and version is not null").groupBy("artifact_id").agg(
        F.min(F.struct("snapshot_id", "kind", "version")).alias("_a")
    ).select("artifact_id", "_a.*").withColumn("_block", F.floor(F.col("version") / BLOCK))
    order = [F.col("version"), F.col("artifact_id")]
    inner = Window.partitionBy("snapshot_id", "kind", "_block").orderBy(*order)
    rows = one.withColumn("_before", F.lag("artifact_id").over(inner))
    last = one.groupBy("snapshot_id", "kind", "_block").agg(F.max_by("artifact_id", F.struct("version", "artifact_id")).alias("_last"))
    outer = Window.partitionBy("snapshot_id", "kind").orderBy("_block")
    last = last.withColumn("_carry", F.lag("_last").over(outer)).drop("_last")
    # null-safe: a null snapshot or kind is a group of its own
    joined = rows.alias("r").join(
        last.alias("l"),
        F.col("r.snapshot_id").eqNullSafe(F.col("l.snapshot_id")) & F.col("r.kind").eqNullSafe(F.col("l.kind")) & (F.col("r._block") == F.col("l._block")),
        "left",
    )
    return joined.select("r.artifact_id", "r.snapshot_id", "r.kind", "r.version", F.coalesce("r._before", "l._carry").alias("prev_id"))


def readable(records: DataFrame) -> DataFrame:
    """The records whose payload is an object, with it as _v and its path."""
    parsed = records.withColumn("_v", F.try_parse_json("payload")).where("_v is not null and schema_of_variant(_v) like 'OBJECT%'")
    return parsed.withColumn("path", F.try_variant_get("_v", "$.path", "string"))


def cells(records: DataFrame) -> DataFrame:
    """Every field of every readable record: (artifact_id, record_id, path, field, type, value); value is canonical JSON."""
    parsed = readable(records.select("artifact_id", "record_id", "payload"))
    out = parsed.lateralJoin(records.sparkSession.tvf.variant_explode(F.col("_v").outer()))
    kind = F.schema_of_variant("value")
    named = F.lit(None).cast("string")
    for name, plain in TYPE_NAMES.items():
        named = F.when(kind == name, plain).otherwise(named)
    named = (
        F.when(kind.startswith("DECIMAL"), "number").when(kind.startswith("ARRAY"), "array")
        .when(kind.startswith("OBJECT"), "object").otherwise(named)
    )
    return out.select("artifact_id", "record_id", "path", F.col("key").alias("field"), named.alias("type"), F.to_json("value").alias("value"))


def fingerprints(fields: DataFrame) -> DataFrame:
    """Fields and types of each artifact with a fingerprint: (artifact_id, fields map, fingerprint).

    A map holds the distinct field names of one artifact, which is the width of its schema and not its number of rows.
    """
    # a set of (field, type) holds each field at most once for each type and once without one
    sets = fields.groupBy("artifact_id").agg(F.collect_set(F.struct("field", F.coalesce("type", F.lit("")).alias("type"))).alias("_s"))
    last = lambda f: F.array_max(F.transform(F.filter("_s", lambda x: x["field"] == f), lambda x: x["type"]))
    names = F.array_sort(F.array_distinct(F.transform("_s", lambda x: x["field"])))
    out = sets.select("artifact_id", F.transform(names, lambda f: F.struct(f.alias("field"), F.nullif(last(f), F.lit("")).alias("type"))).alias("_f"))
    return out.select("artifact_id", F.map_from_entries("_f").alias("fields"), F.md5(F.to_json("_f")).alias("fingerprint"))


def migration_steps(artifacts: DataFrame, records: DataFrame, seen: DataFrame | None = None) -> DataFrame:
    """Each change between consecutive versions: (artifact_id, change, old_field, new_field, old_type, new_type).

    ``seen`` may give the records' cells where they are at hand.
    """
    seen = checkpointed(cells(records)) if seen is None else seen
    prints = fingerprints(seen)
    chain = ordered_artifacts(artifacts).select("artifact_id", "prev_id")
    empty = F.expr("cast(map() as map<string,string>)")
    pairs = (
        chain.where("prev_id is not null")
        .join(prints, "artifact_id", "left")
        .join(prints.select(F.col("artifact_id").alias("prev_id"), F.col("fields").alias("old"), F.col("fingerprint").alias("old_print")), "prev_id", "left")
        .where("not (fingerprint <=> old_print)")
        .select("artifact_id", "prev_id", F.coalesce("old", empty).alias("old"), F.coalesce("fields", empty).alias("new"))
    )
    gone = F.array_except(F.map_keys("old"), F.map_keys("new"))
    come = F.array_except(F.map_keys("new"), F.map_keys("old"))
    kept = F.array_intersect(F.map_keys("old"), F.map_keys("new"))
    pairs = pairs.select("artifact_id", "prev_id", "old", "new", gone.alias("gone"), come.alias("come"), kept.alias("kept"))

    # values are read only of the fields that went or came, and only where both happened
    both = pairs.where("size(gone) > 0 and size(come) > 0")
    told = seen.where("path is not null and value <> 'null'").select("artifact_id", "path", "field", "value")
    seen_in = lambda w: told.join(w, "artifact_id").where(F.array_contains("names", F.col("field")))
    went = both.select(F.col("prev_id").alias("artifact_id"), F.col("gone").alias("names"))  # a version has one successor
    before = seen_in(went).select(F.col("artifact_id").alias("prev_id"), "path", F.col("field").alias("old_field"), F.col("value").alias("old_value")).distinct()
    before = before.join(both.select("artifact_id", "prev_id"), "prev_id")
    after = seen_in(both.select("artifact_id", F.col("come").alias("names"))).select("artifact_id", "path", F.col("field").alias("new_field"), F.col("value").alias("new_value")).distinct()
    support = before.join(after, ["artifact_id", "path"]).groupBy("artifact_id", "old_field", "new_field").agg(
        F.count_if(F.col("old_value") == F.col("new_value")).alias("same"), F.count(F.lit(1)).alias("shared")
    ).where("same > 0 and same = shared")
    near = F.levenshtein(F.lower("old_field"), F.lower("new_field"))
    by_old = Window.partitionBy("artifact_id", "old_field").orderBy(F.desc("same"), near, "new_field")
    by_new = Window.partitionBy("artifact_id", "new_field").orderBy(F.desc("same"), near, "old_field")
    renamed = support.withColumn("_o", F.row_number().over(by_old)).withColumn("_n", F.row_number().over(by_new)).where("_o = 1 and _n = 1")
    moved = renamed.groupBy("artifact_id").agg(F.collect_list(F.struct("old_field", "new_field")).alias("moved"))

    row = lambda change, old, new: F.struct(
        F.lit(change).alias("change"), old.alias("old_field"), new.alias("new_field"))
    all_moved = F.coalesce(F.col("moved"), F.expr("cast(array() as array<struct<old_field:string,new_field:string>>)"))
    told = pairs.join(moved, "artifact_id", "left").withColumn("moved", all_moved)
    steps = F.concat(
        F.transform("moved", lambda m: row("renamed", m["old_field"], m["new_field"])),
        F.transform(F.array_except("gone", F.transform("moved", lambda m: m["old_field"])), lambda f: row("removed", f, F.lit(""))),
        F.transform(F.array_except("come", F.transform("moved", lambda m: m["new_field"])), lambda f: row("added", F.lit(""), f)),
        F.transform(F.filter("kept", lambda f: F.col("old")[f] != F.col("new")[f]), lambda f: row("retyped", f, f)),
    )
    out = told.select("artifact_id", "old", "new", F.explode(steps).alias("s"))
    return out.select(
        "artifact_id", "s.*", F.try_element_at("old", F.col("s.old_field")).alias("old_type"), F.try_element_at("new", F.col("s.new_field")).alias("new_type"))


def consistent_table(artifacts: DataFrame, records: DataFrame, steps: DataFrame, seen: DataFrame | None = None) -> DataFrame:
    """All readable records in one table.

    (record_id, artifact_id, snapshot_id, kind, version, path, field, type, value, source_field, cast_failed).

    Long form, one row per field of the last version of the record's chain; a field that the record lacks is null and
    has no source_field. Records of unknown artifacts, or of artifacts without a version, have no chain and keep their
    own fields; a record without any field keeps one row with a null field. The names are canonical: renames between
    the record's version and the last version are followed by pointer doubling, so the number of rounds is the
    logarithm of the longest chain. Values are cast to the field's last type where JSON allows it, else null with the
    type kept and cast_failed true; fields that later versions removed keep their last name.
    """
    chain = ordered_artifacts(artifacts)
    nxt = chain.where("prev_id is not null").select(F.col("prev_id").alias("artifact_id"), F.col("artifact_id").alias("next_id"))
    seen = checkpointed(cells(records)) if seen is None else seen
    held = seen.select("artifact_id", "field").distinct()
    named = steps.where("change = 'renamed'").select(F.col("artifact_id").alias("next_id"), F.col("old_field").alias("field"), "new_field")
    hop = held.join(nxt, "artifact_id", "left").join(named, ["next_id", "field"], "left").select(
        "artifact_id", "field", F.col("next_id").alias("to_id"), F.coalesce("new_field", "field").alias("to_field"))
    # a hop ends where the next version lacks the field (it was removed)
    there = held.select(F.col("artifact_id").alias("to_id"), F.col("field").alias("to_field"), F.lit(True).alias("_there"))
    hop = hop.join(there, ["to_id", "to_field"], "left").select(
        "artifact_id", "field", F.when(F.col("_there"), F.col("to_id")).alias("to_id"), F.when(F.col("_there"), F.col("to_field")).otherwise(F.col("field")).alias("to_field"))
    hop = checkpointed(hop)
    while True:
        far = hop.select(F.col("artifact_id").alias("to_id"), F.col("field").alias("to_field"), F.col("to_id").alias("_id2"), F.col("to_field").alias("_field2"))
        step = hop.join(far, ["to_id", "to_field"], "left").select(
            "artifact_id", "field", F.coalesce("_id2", "to_id").alias("to_id"),
            F.when(F.col("_id2").isNotNull(), F.col("_field2")).otherwise(F.col("to_field")).alias("to_field"),
            F.col("_id2").isNotNull().alias("_moved"))
        step = checkpointed(step)
        moved = step.where("_moved").limit(1).count()
        hop = step.drop("_moved")
        if not moved:
            break
    types = seen.where("type is not null").groupBy("artifact_id", "field").agg(F.max("type").alias("type"))
    final = hop.select("artifact_id", "field", F.coalesce("to_id", "artifact_id").alias("_at"), F.col("to_field").alias("_name")).join(
        types.select(F.col("artifact_id").alias("_at"), F.col("field").alias("_name"), F.col("type").alias("_type")), ["_at", "_name"], "left")
    bare = F.when(F.col("type") == "string", F.get_json_object(F.concat(F.lit('{"v":'), F.col("value"), F.lit("}")), "$.v")).otherwise(F.col("value"))
    cast = (
        F.when(F.col("value") == "null", F.lit(None).cast("string"))
        .when((F.col("_type") == F.col("type")) | F.col("_type").isNull(), F.col("value"))
        .when(F.col("_type") == "string", F.to_json(F.to_variant_object(F.struct(bare.alias("v")))).substr(F.lit(6), F.length(F.to_json(F.to_variant_object(F.struct(bare.alias("v"))))) - 6))
        .when((F.col("_type") == "number") & bare.try_cast("double").isNotNull(), bare)
        .when((F.col("_type") == "boolean") & F.lower(bare).isin("true", "false"), F.lower(bare))
        .when(F.col("_type") == "array", F.concat(F.lit("["), F.col("value"), F.lit("]")))
    )
    key = F.struct(F.col("version").isNull().alias("_n"), "snapshot_id", "kind", "version")
    meta = artifacts.where("artifact_id is not null").groupBy("artifact_id").agg(F.min_by(F.struct("snapshot_id", "kind", "version"), key).alias("_m")).select("artifact_id", "_m.*")
    one = seen.join(final, ["artifact_id", "field"], "left").select(
        "record_id", "artifact_id", "path", F.coalesce("_name", "field").alias("field"), F.coalesce("_type", "type").alias("type"), cast.alias("value"), F.col("field").alias("source_field"),
        (cast.isNull() & (F.col("value") != "null")).alias("cast_failed"))
    # the fields of the chain's last version that a record lacks
    last = chain.groupBy("snapshot_id", "kind").agg(F.max_by("artifact_id", F.struct("version", "artifact_id")).alias("_last"))
    ends = chain.alias("c").join(last.alias("l"), F.col("c.snapshot_id").eqNullSafe(F.col("l.snapshot_id")) & F.col("c.kind").eqNullSafe(F.col("l.kind"))).select("c.artifact_id", "l._last")
    shape = held.join(types, ["artifact_id", "field"], "left").select(F.col("artifact_id").alias("_last"), "field", "type")
    wanted = ends.join(shape, "_last").drop("_last")
    rows = readable(records.select("artifact_id", "record_id", "payload")).select("record_id", "artifact_id", "path").distinct()
    lacking = rows.join(wanted, "artifact_id").join(one.select("record_id", "artifact_id", "field").distinct(), ["record_id", "artifact_id", "field"], "left_anti")
    none = F.lit(None).cast("string")
    lacking = lacking.select("record_id", "artifact_id", "path", "field", "type", none.alias("value"), none.alias("source_field"), F.lit(False).alias("cast_failed"))
    every = one.unionByName(lacking)
    # a record without any field, where the last version has none either
    empty = rows.join(every.select("record_id").distinct(), "record_id", "left_anti")
    empty = empty.select("record_id", "artifact_id", "path", none.alias("field"), none.alias("type"), none.alias("value"), none.alias("source_field"), F.lit(False).alias("cast_failed"))
    return every.unionByName(empty).join(meta, "artifact_id", "left").select(
        "record_id", "artifact_id", "snapshot_id", "kind", "version", "path", "field", "type", "value", "source_field", "cast_failed")
