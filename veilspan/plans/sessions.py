"""Sessions: one numbering of tokens over many documents, the token map, its JSON form and guarded unmasking."""

from __future__ import annotations

import secrets

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import masks
from .lineage import cut
from .redaction import Options, resolve, with_replaced

TOKEN = "⟦RDT:([A-Za-z0-9]+):([A-Z_]+):([0-9]+)⟧"
LEGACY = r"^\[([A-Z_]+)_([0-9]+)\]$"


def new_session() -> str:
    """128 random bits, drawn once on the driver."""
    return secrets.token_hex(16)


def parse_token(token: Column) -> Column:
    """struct<session, entity_type, index>; null for what is no token, a null session for the legacy form."""
    whole = f"^{TOKEN}$"
    one = F.struct(F.regexp_extract(token, whole, 1).alias("session"), F.regexp_extract(token, whole, 2).alias("entity_type"), F.regexp_extract(token, whole, 3).try_cast("long").alias("index"))
    old = F.struct(F.lit(None).cast("string").alias("session"), F.regexp_extract(token, LEGACY, 1).alias("entity_type"), F.regexp_extract(token, LEGACY, 2).try_cast("long").alias("index"))
    return F.when(token.rlike(whole), one).when(token.rlike(LEGACY), old)


def numbered(keys: DataFrame, groups: list[str], order: str) -> DataFrame:
    """Adds ``index`` from 1 within ``groups`` by ``order`` without gathering a group in one task.

    Rows are sorted over ranges and pinned; each partition numbers its part of a group, and the counts of the
    partitions before it are added. Only one row a group and partition reaches the sum over partitions.
    """
    pinned = cut(keys.repartitionByRange(*groups, order).sortWithinPartitions(*groups, order).withColumn("_at", F.monotonically_increasing_id()))
    pinned = pinned.withColumn("_part", F.shiftright("_at", 33))
    parts = pinned.groupBy(*groups, "_part").agg(F.count("*").alias("_n"))
    before = Window.partitionBy(*groups).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    parts = parts.select(*groups, "_part", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"))
    own = Window.partitionBy(*groups, "_part").orderBy("_at")
    rows = pinned.withColumn("_own", F.row_number().over(own)).join(parts, [*groups, "_part"])
    return rows.withColumn("index", F.col("_own") + F.col("_before")).drop("_at", "_part", "_own", "_before")


def _floors(found: DataFrame, known: DataFrame | None, session: str, text: str) -> DataFrame:
    """(session, entity_type, floor): new numbers start above those known and those whose token stands in a text of the session already."""
    own = r"⟦RDT:[A-Za-z0-9]+:[^:⟦⟧]+:[0-9]{1,15}⟧"
    held = found.where(F.col(text).contains("⟦RDT:")).select(session, F.explode(F.regexp_extract_all(text, F.lit(own), F.lit(0))).alias("_t"))
    part = lambda i: F.split_part("_t", F.lit(":"), F.lit(i))
    floors = held.where(part(2) == F.col(session)).select(session, part(3).alias("entity_type"), F.rtrim(part(4), F.lit("⟧")).cast("long").alias("index"))
    if known is not None:
        floors = floors.unionByName(known.select(session, "entity_type", "index"))
    return floors.groupBy(session, "entity_type").agg(F.max("index").alias("_floor"))


def redact_sessions(df: DataFrame, key: str, session: str, seq: str, options: Options = Options(), text: str = "text", known: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """(documents with ``redacted`` and ``spans``, token map): equal canonical values of a session share a token.

    ``known`` is the token map of earlier calls: its values keep their tokens, and the map returned holds new ones only.

    ``key`` is unique; values are numbered by session and type in order of (``seq``, ``key``, position). The map
    (session, token, entity_type, canonical, original, index) holds the first spelling and is sensitive.
    A row whose session is null gets labels instead of tokens.
    """
    found = cut(resolve(df, options, text))
    rows = found.where(F.col(session).isNotNull()).select(key, session, seq, F.explode("spans").alias("_span"))
    ident = [session, "entity_type", "canonical"]
    seen = rows.select(session, F.struct(F.col(seq).alias("seq"), F.col(key).alias("key"), F.col("_span.start").alias("start")).alias("first"), F.col("_span.entity_type").alias("entity_type"), F.col("_span.canonical").alias("canonical"), F.col("_span.value").alias("value"))
    keys = seen.groupBy(*ident).agg(F.min("first").alias("first"), F.min_by("value", "first").alias("original"))
    if known is not None:
        keys = keys.join(known.select(*ident), ident, "left_anti")
    keys = numbered(keys, [session, "entity_type"], "first").drop("first").join(_floors(found, known, session, text), [session, "entity_type"], "left")
    keys = cut(keys.withColumn("index", F.col("index") + F.coalesce("_floor", F.lit(0))).drop("_floor"))
    every = keys if known is None else keys.unionByName(known.select(*keys.columns))
    marked = rows.select(key, session, F.col("_span.entity_type").alias("entity_type"), F.col("_span.canonical").alias("canonical"), F.col("_span.start").alias("start")).join(every.drop("original"), ident)
    by_doc = marked.groupBy(key).agg(F.array_sort(F.collect_list(F.struct("start", "index"))).alias("_index"))
    out = found.join(by_doc, key, "left")
    out = out.withColumn("spans", F.zip_with("spans", F.coalesce("_index", F.array()), lambda c, i: c.withField("index", i["index"]))).drop("_index")
    token = lambda c: F.coalesce(masks.token(F.col(session), c["entity_type"], c["index"]), masks.label(c["entity_type"]))
    out = with_replaced(out, text, token).withColumn("n_redacted", F.size("spans").cast("long"))
    tokens = keys.select(session, masks.token(F.col(session), F.col("entity_type"), F.col("index")).alias("token"), "entity_type", "canonical", "original", "index")
    return out, tokens


def unmask_sessions(df: DataFrame, tokens: DataFrame, key: str, session: str, expected: str | None = None) -> DataFrame:
    """Adds ``unmasked``; a token of another session, or another session than ``expected``, gives null and sets ``unsafe``.

    Tokens are joined one row each, so a session's map of any size is never gathered.
    """
    pieces = df.select(key, session, F.posexplode(F.split("redacted", "(?<=⟧)|(?=⟦)")).alias("at", "piece"))
    pieces = pieces.withColumn("owner", F.when(F.col("piece").rlike(f"^{TOKEN}$"), F.regexp_extract("piece", TOKEN, 1)))
    is_token = F.col("owner").isNotNull()
    known = pieces.where(is_token).join(tokens.select(session, F.col("token").alias("piece"), "original"), [session, "piece"], "left")
    whole = pieces.where(~is_token).withColumn("original", F.lit(None).cast("string")).unionByName(known)
    foreign = F.max((F.col("owner") != F.col(session)).cast("int"))
    text = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("at", F.coalesce("original", "piece").alias("x")))), lambda p: p["x"]), "")
    done = whole.groupBy(key).agg(text.alias("_text"), F.coalesce(foreign, F.lit(0)).alias("_foreign"))
    bad = (F.coalesce("_foreign", F.lit(0)) > 0) | (F.lit(False) if expected is None else F.col(session) != expected)
    return df.join(done, key, "left").withColumn("unsafe", bad).withColumn("unmasked", F.when(~bad, F.col("_text"))).drop("_text", "_foreign")


def map_to_json(map_column: Column, sensitive: bool = False) -> Column:
    """The map as JSON; unless ``sensitive`` only the tokens, without originals."""
    return F.to_json(map_column) if sensitive else F.to_json(F.struct(F.map_keys(map_column).alias("tokens")))


def map_from_json(text: Column) -> Column:
    """Entries that map a string to a string; others, and text that is no object, are left out."""
    entries = F.try_variant_get(F.try_parse_json(text), "$", "map<string,variant>")
    strings = F.map_filter(entries, lambda k, v: F.schema_of_variant(v) == "STRING")
    return F.coalesce(F.transform_values(strings, lambda k, v: v.cast("string")), F.create_map().cast("map<string,string>"))


def merged(into: Column, new: Column) -> Column:
    """Entries of both maps; those of ``new`` win."""
    kept = F.map_filter(into, lambda k, v: ~F.map_contains_key(new, k))
    return F.map_concat(kept, new)
