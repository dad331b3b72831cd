"""Tool calls linked to their results, ordered, validated and serialised; DataFrame functions only.

``calls`` has ``call_id``, ``name``, ``arguments`` (JSON text) and ``after`` (the call it depends on); ``results`` has ``call_id`` and ``content``.

* Results are reduced to one per identifier (the smallest content, and their number) before the hash join, so repeats don't multiply.
* ``level`` is the place in the topological order: 0 without a known call before it, else one more than that call's.  It comes from
  doubling jumps, so a chain of n calls takes log2(n) rounds.  Calls on or behind a cycle get a null level.
* ``valid`` says that the arguments are a JSON object with every required field, only known fields, and the types of the tool's schema.
* ``json`` is canonical: keys in code point order, no blanks, the arguments as parsed.

Defined results: a null identifier, here or in ``after``, links with nothing; arguments that aren't JSON, or repeat a key, give
``valid`` false and null in ``json``; an unknown tool is not valid; results without a call are rows with a null name; repeated calls
each give one row; empty tables give an empty one; other columns of ``calls`` are kept only if named in ``carry``.
"""

from __future__ import annotations

from math import ceil, log2

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from roadsift.functions.durable import stored

# tool -> field -> (variant type, required)
Schemas = dict[str, dict[str, tuple[str, bool]]]


def levels(calls: DataFrame) -> DataFrame:
    """``call_id``, ``level``; null on or behind a cycle."""
    nodes = calls.where(F.col("call_id").isNotNull()).groupBy("call_id").agg(F.min("after").alias("after"))
    known = nodes.select(F.col("call_id").alias("after"), F.lit(True).alias("there"))
    jumps = stored(nodes.join(known, "after", "left").select("call_id", F.when(F.col("there"), F.col("after")).alias("to"), F.coalesce("there", F.lit(False)).cast("long").alias("hops")), "jumps")
    rounds, most = 0, 1 + ceil(log2(max(2, jumps.count())))
    while rounds < most and not jumps.where(F.col("to").isNotNull()).isEmpty():
        ahead = jumps.select(F.col("call_id").alias("to"), F.col("to").alias("next"), F.col("hops").alias("more"))
        jumps = stored(jumps.join(ahead, "to", "left").select("call_id", F.col("next").alias("to"), (F.col("hops") + F.coalesce("more", F.lit(0))).alias("hops")), "jumps")
        rounds += 1
    return jumps.select("call_id", F.when(F.col("to").isNull(), F.col("hops")).alias("level"))


def arguments_valid(name: Column, parsed: Column, schemas: Schemas) -> Column:
    """Whether parsed arguments fit the schema of the named tool."""
    verdict = F.lit(False)
    for tool, fields in sorted(schemas.items()):
        keys = F.json_object_keys(F.to_json(parsed))
        fits = F.schema_of_variant(parsed).startswith("OBJECT") & (F.size(F.array_except(keys, F.array(*[F.lit(f) for f in sorted(fields)]))) == 0)
        for field, (kind, required) in sorted(fields.items()):
            got = F.schema_of_variant(F.try_variant_get(parsed, f"$.{field}", "variant"))
            fits = fits & F.coalesce(got == kind, F.lit(not required))
        verdict = F.when(name == tool, fits).otherwise(verdict)
    return F.coalesce(verdict, F.lit(False))


def link_calls(calls: DataFrame, results: DataFrame, schemas: Schemas, carry: tuple[str, ...] = ()) -> DataFrame:
    """``carry``, ``call_id``, ``name``, ``level``, ``n_results``, ``valid``, ``json`` for every call, and for results without one."""
    one = results.where(F.col("call_id").isNotNull()).groupBy("call_id").agg(F.count("*").alias("n_results"), F.min("content").alias("result"))
    slim = calls.select(*carry, "call_id", "name", "arguments", "after")
    placed = slim.join(levels(slim).hint("shuffle_hash"), "call_id", "left").join(one.hint("shuffle_hash"), "call_id", "left")
    placed = placed.withColumn("level", F.when(F.col("call_id").isNull(), F.lit(0).cast("long")).otherwise(F.col("level")))
    parsed = placed.withColumn("parsed", F.try_parse_json("arguments")).withColumn("n_results", F.coalesce("n_results", F.lit(0)))
    linked = parsed.withColumn("valid", arguments_valid(F.col("name"), F.col("parsed"), schemas))
    orphans = one.join(slim.select("call_id"), "call_id", "left_anti")
    orphans = orphans.select(*[F.lit(None).cast(slim.schema[c].dataType).alias(c) for c in carry], "call_id", F.lit(None).cast("string").alias("name"),
                             F.lit(None).cast("long").alias("level"), "n_results", F.lit(False).alias("valid"), F.lit(None).cast("variant").alias("parsed"), "result")
    columns = [*carry, "call_id", "name", "level", "n_results", "valid"]
    everything = linked.select(*columns, "parsed", "result").unionByName(orphans.select(*columns, "parsed", "result"))
    message = F.struct(F.col("parsed").alias("arguments"), F.col("call_id").alias("id"), "name", "result")
    return everything.select(*columns, F.to_json(message, {"ignoreNullFields": "false"}).alias("json"))
