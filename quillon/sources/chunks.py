"""Readers of nested JSON: root shapes, chunk and label fields found by trying known names; typed decoding.

A JSON document is one row until its items are exploded, as its array cannot be split before it is parsed; archives of
many files are read in parallel. Gzip is undone by suffix.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quillon.functions.labels import hash_split
from quillon.functions.scalars import parse_time, seat_of_uid
from quillon.sources.large_json import read_arrays

#: Names under which roots, chunks, labels and ids are looked for, in order.
ROOT_KEYS = ("labeled_chunks", "samples", "data", "chunks", "items", "records")
SPLIT_KEYS = (("train", "train"), ("validation", "validation"), ("splits.train", "train"), ("splits.validation", "validation"))
HAND_KEYS = ("hands", "chunk", "batch", "hand_history", "payload", "items", "data", "sample", "input")
LABEL_KEYS = ("label", "target", "y", "class", "ground_truth", "groundTruth")
ID_KEYS = ("chunk_id", "id", "sample_id", "uid", "chunkId")

ACTION = (
    "struct<action_id:string,street:string,actor_seat:int,action_type:string,amount:double,raise_to:double,call_to:double,"
    "normalized_amount_bb:double,pot_before:double,pot_after:double,timestamp_action:string,id:string>"
)
HAND = (
    "struct<metadata:struct<game_type:string,limit_type:string,max_seats:int,hero_seat:int,hand_ended_on_street:string,button_seat:int,"
    "sb:double,bb:double,ante:double,rng_seed_commitment:string>,"
    "players:array<struct<player_uid:string,seat:int,starting_stack:double,hole_cards:array<string>,showed_hand:boolean>>,"
    f"streets:array<struct<street:string,board_cards:array<string>,name:string>>,actions:array<{ACTION}>,"
    "outcome:struct<winners:array<string>,payouts:map<string,double>,total_pot:double,rake:double,result_reason:string,showdown:boolean,hand_result_reason:string>,label:string>"
)


def _get(v: Column, path: str, kind: str) -> Column:
    return F.try_variant_get(v, path, kind)


def read_documents(spark: SparkSession, path: str, *, glob: str = "*.json*") -> DataFrame:
    """file and root (variant) of every JSON document; the root is null where the text is no JSON."""
    text = spark.read.option("pathGlobFilter", glob).text(path, wholetext=True)
    return text.select(F.col("_metadata.file_path").alias("file"), F.try_parse_json("value").alias("root"))


def read_items(spark: SparkSession, path: str, *, glob: str = "*.json*") -> DataFrame:
    """file, split (null if untold), nth, item (variant) of every element of every document's root array.

    The root is an array itself, or an object that holds one under a split's or a known name. A root that holds none
    gives no items.
    """
    docs = read_documents(spark, path, glob=glob)
    told = lambda p: _get(F.col("root"), p, "array<variant>")
    none = F.lit(None).cast("string")
    sources = [F.struct(F.lit(s).alias("split"), told(f"$.{k}").alias("items")) for k, s in SPLIT_KEYS]
    plain = F.struct(none.alias("split"), F.coalesce(told("$"), *(told(f"$.{k}") for k in ROOT_KEYS), *(told(f"$.data.{k}") for k in ROOT_KEYS)).alias("items"))
    shapes = F.filter(F.array(*sources), lambda x: x["items"].isNotNull())
    shapes = F.when(F.size(shapes) > 0, shapes).otherwise(F.array(plain))
    rows = docs.where(F.col("root").isNotNull()).select("file", F.explode(shapes).alias("s"))
    return rows.select("file", "s.split", F.posexplode("s.items").alias("nth", "item"))


def read_large_items(spark: SparkSession, path: str, *, glob: str = "*.json*") -> DataFrame:
    """As ``read_items``, for documents of any size: an item is a row from the start, and no document is ever whole. The
    documents are parsed twice, first for the arrays they have."""
    found = read_arrays(spark, path, glob=glob)
    ranks = [(k, s, 0) for k, s in SPLIT_KEYS] + [(k, None, i + 1) for i, k in enumerate(("", *ROOT_KEYS, *(f"data.{k}" for k in ROOT_KEYS)))]
    known = F.broadcast(spark.createDataFrame(ranks, "path string, split string, rank int"))
    arrays = found.where("nth = -1").select("file", "path").distinct().join(known, "path")
    best = arrays.groupBy("file").agg(F.min("rank").alias("rank"))
    chosen = arrays.join(best, ["file", "rank"]).select("file", "path", "split")
    items = found.where("nth >= 0").join(chosen, ["file", "path"])
    return items.select("file", "split", F.col("nth").cast("int").alias("nth"), F.try_parse_json("text").alias("item"))


def label_of_item(item: Column) -> Column:
    """1, 0 or null: flags first, then the label fields (words, numbers or one-element lists)."""

    def value(path: str) -> Column:
        t = F.lower(F.trim(F.coalesce(_get(item, path, "string"), _get(item, path + "[0]", "string"))))
        n = t.try_cast("double")
        return F.when(t.isin("bot", "ai", "true"), 1).when(t.isin("human", "false"), 0).when(n.isin(0.0, 1.0), n.cast("int"))

    flags = [value("$.is_bot"), 1 - value("$.is_human"), value("$.bot"), 1 - value("$.human")]
    return F.coalesce(*flags, *(value(f"$.{k}") for k in LABEL_KEYS), value("$.metadata.label"))


def hands_of_item(item: Column) -> Column:
    """The array of hands: the item itself, or under a known name, or one level deeper in a single-element list."""
    tried = [_get(item, "$", "array<variant>"), *(_get(item, f"$.{k}", "array<variant>") for k in HAND_KEYS)]
    found = F.coalesce(*tried)
    inner = F.try_variant_get(F.get(found, F.lit(0)), "$", "array<variant>")
    return F.when((F.size(found) == 1) & inner.isNotNull(), inner).otherwise(found)


def looks_like_hand(hand: Column, required: tuple[str, ...] = ("metadata", "players", "streets", "actions", "outcome")) -> Column:
    keys = F.json_object_keys(F.to_json(hand))
    return F.coalesce(F.size(F.array_except(F.array(*map(F.lit, required)), keys)) == 0, F.lit(False))


def read_chunks(spark: SparkSession, path: str, *, glob: str = "*.json*", large: bool = False) -> DataFrame:
    """file, split, chunk_id, label, source_date, hands (typed) of every item that has hands; the others are left to
    ``rejected_items``. An id that is missing becomes ``sample_`` and the item's number. ``large``: documents of any size."""
    items = (read_large_items if large else read_items)(spark, path, glob=glob).withColumn("raw", hands_of_item(F.col("item")))
    ids = F.coalesce(*(_get(F.col("item"), f"$.{k}", "string") for k in ID_KEYS), F.concat(F.lit("sample_"), F.col("nth").cast("string")))
    hands = F.filter(F.transform("raw", lambda h: F.from_json(F.to_json(h), HAND)), lambda h: h.isNotNull())
    split = F.coalesce("split", _get(F.col("item"), "$.split", "string"))
    return items.where(F.size("raw") > 0).select(
        "file", split.alias("split"), ids.alias("chunk_id"), label_of_item(F.col("item")).alias("label"), _get(F.col("item"), "$.source_date", "string").alias("source_date"), hands.alias("hands")
    )


def rejected_items(spark: SparkSession, path: str, *, glob: str = "*.json*") -> DataFrame:
    """file and nth of the items without hands, for counting what was skipped."""
    return read_items(spark, path, glob=glob).where(F.coalesce(F.size(hands_of_item(F.col("item"))), F.lit(0)) <= 0).select("file", "nth")


def is_labelled(chunks: DataFrame) -> DataFrame:
    """One row: whether any chunk has a label, and whether all have."""
    return chunks.agg(F.bool_or(F.col("label").isNotNull()).alias("some"), F.bool_and(F.col("label").isNotNull()).alias("all"))


def read_release(spark: SparkSession, path: str) -> DataFrame:
    """Chunks of the release shape: each record's list of hand lists zipped with its list of truths."""
    root = read_documents(spark, path)
    records = root.select(F.explode(F.coalesce(_get(F.col("root"), "$.data.chunks", "array<variant>"), _get(F.col("root"), "$.chunks", "array<variant>"))).alias("r"))
    r = F.col("r")
    zipped = F.arrays_zip(_get(r, "$.chunks", "array<variant>").alias("hands"), _get(r, "$.groundTruth", "array<int>").alias("label"))
    rows = records.select(
        _get(r, "$.chunkHash", "string").alias("hash"), _get(r, "$.chunkId", "string").alias("record"), _get(r, "$.split", "string").alias("split"),
        _get(r, "$.sourceDate", "string").alias("source_date"), F.posexplode(zipped).alias("nth", "x"),
    )
    typed = F.transform(F.try_variant_get(F.col("x.hands"), "$", "array<variant>"), lambda h: F.from_json(F.to_json(h), HAND))
    return rows.select("hash", F.concat_ws("-", "record", "nth").alias("chunk_id"), "split", "source_date", F.col("x.label").alias("label"), typed.alias("hands"))


def actions_of(chunks: DataFrame) -> DataFrame:
    """chunk_id, hand_idx, ord and the action's fields: the exploded form, in the order of the numeric action id (ids that
    are no numbers count as 0; ties keep their place)."""
    hands = chunks.select("chunk_id", F.posexplode("hands").alias("hand_idx", "hand"))
    order = F.transform("hand.actions", lambda a, i: F.struct(F.coalesce(a["action_id"].try_cast("int"), F.lit(0)).alias("key"), i.alias("i"), a.alias("a")))
    placed = hands.select("chunk_id", "hand_idx", F.posexplode(F.array_sort(order)).alias("ord", "x"))
    return placed.select("chunk_id", "hand_idx", (F.col("ord") + 1).alias("ord"), "x.a.*")


def _filled(x: Column, default) -> Column:
    """The value, or ``default`` for null and, as for all empty values, for the empty text."""
    return F.coalesce(F.nullif(x, F.lit("")) if isinstance(default, str) else x, F.lit(default))


def decoded(chunks: DataFrame) -> DataFrame:
    """``chunks`` with every hand's fields filled as a typed record has them: numbers 0, texts empty, lists empty, street
    preflop, an action's identifier from action_id or id, its time null unless it can be read, a street's name from street
    or name, the reason from either of its two fields, and label_flag (true for a bot) from the label's word."""

    def metadata(m: Column) -> Column:
        numbers = [_filled(m[c], 0).alias(c) for c in ("max_seats", "hero_seat", "button_seat")]
        texts = [_filled(m[c], "").alias(c) for c in ("game_type", "limit_type", "hand_ended_on_street")]
        return F.struct(*texts, *numbers, *(_filled(m[c], 0.0).alias(c) for c in ("sb", "bb", "ante")), m["rng_seed_commitment"].alias("rng_seed_commitment"))

    def action(a: Column) -> Column:
        return F.struct(
            F.coalesce(F.nullif(a["action_id"], F.lit("")), a["id"]).alias("action_id"), _filled(a["street"], "preflop").alias("street"), _filled(a["actor_seat"], 0).alias("actor_seat"),
            _filled(a["action_type"], "").alias("action_type"), _filled(a["amount"], 0.0).alias("amount"), a["raise_to"].alias("raise_to"), a["call_to"].alias("call_to"),
            *(_filled(a[c], 0.0).alias(c) for c in ("normalized_amount_bb", "pot_before", "pot_after")), parse_time(a["timestamp_action"]).alias("timestamp_action"),
        )

    def outcome(o: Column) -> Column:
        reason = F.coalesce(F.nullif(o["result_reason"], F.lit("")), F.nullif(o["hand_result_reason"], F.lit("")), F.lit(""))
        return F.struct(
            F.coalesce(o["winners"], F.array().cast("array<string>")).alias("winners"), F.coalesce(o["payouts"], F.create_map().cast("map<string,double>")).alias("payouts"),
            _filled(o["total_pot"], 0.0).alias("total_pot"), _filled(o["rake"], 0.0).alias("rake"), reason.alias("result_reason"), _filled(o["showdown"], False).alias("showdown"),
        )

    def street(x: Column) -> Column:
        return F.struct(F.coalesce(F.nullif(x["street"], F.lit("")), x["name"]).alias("street"), F.coalesce(x["board_cards"], F.array().cast("array<string>")).alias("board_cards"))

    def listed(x: Column, f) -> Column:
        out = F.transform(x, f)
        return F.coalesce(out, F.array())

    def hand(h: Column) -> Column:
        word = F.lower(F.trim(h["label"]))
        flag = F.when(word.isin("human", "false", "0"), False).when(word.isin("ai", "bot", "true", "1"), True)
        return F.struct(
            metadata(h["metadata"]).alias("metadata"), F.coalesce(h["players"], F.array()).alias("players"), listed(h["streets"], street).alias("streets"),
            listed(h["actions"], action).alias("actions"), outcome(h["outcome"]).alias("outcome"), h["label"].alias("label"), flag.alias("label_flag"),
        )

    return chunks.withColumn("hands", F.transform("hands", hand))


def payload_of(hand: Column, *, label: bool = True) -> Column:
    """The six projections of a decoded hand: metadata, players, streets, actions, outcome and the hand around them, with
    the fields that such records are exchanged with. ``label`` (bot, human) is null where the hand has none; it and a
    player's ending_stack and is_bot are left out of the text where they are null (``PAYLOAD_OPTIONAL``)."""
    pick = lambda x, names: F.struct(*(x[n].alias(n) for n in names.split()))
    fields = [
        pick(hand["metadata"], "game_type limit_type max_seats hero_seat hand_ended_on_street button_seat sb bb ante rng_seed_commitment").alias("metadata"),
        F.transform(hand["players"], lambda p: pick(p, "player_uid seat starting_stack hole_cards showed_hand")).alias("players"),
        F.transform(hand["streets"], lambda s: pick(s, "street board_cards")).alias("streets"),
        F.transform(hand["actions"], lambda a: pick(a, "action_id street actor_seat action_type amount raise_to call_to normalized_amount_bb pot_before pot_after")).alias("actions"),
        pick(hand["outcome"], "winners payouts total_pot rake result_reason showdown").alias("outcome"),
    ]
    word = F.when(hand["label_flag"], "bot").when(~hand["label_flag"], "human").alias("label")
    return F.struct(*fields, *([word] if label else []))


#: Fields of a payload that are not written where they are null.
PAYLOAD_OPTIONAL = frozenset({"label", "ending_stack", "is_bot"})


def _hands(chunks: DataFrame) -> DataFrame:
    """chunk_id, hand_id (the chunk's id and the hand's number), hand_idx and the hand."""
    hands = chunks.select("chunk_id", F.posexplode("hands").alias("hand_idx", "hand"))
    return hands.select("chunk_id", F.concat_ws("#", "chunk_id", "hand_idx").alias("hand_id"), "hand_idx", "hand")


def hands_of(chunks: DataFrame) -> DataFrame:
    """One row per hand, as the feature, encoding and canonical operators read hands: chunk_id, hand_id, hand_idx,
    hero_seat, button_seat, max_seats, n_players, bb, sb, game_type, limit_type, showdown. Missing numbers are 0, missing
    texts empty."""
    m, o = F.col("hand.metadata"), F.col("hand.outcome")
    return _hands(chunks).select(
        "chunk_id", "hand_id", "hand_idx", *(_filled(m[c], 0).alias(c) for c in ("hero_seat", "button_seat", "max_seats")), F.coalesce(F.size("hand.players"), F.lit(0)).alias("n_players"),
        *(_filled(m[c], 0.0).alias(c) for c in ("bb", "sb")), *(_filled(m[c], "").alias(c) for c in ("game_type", "limit_type")), _filled(o["showdown"], False).alias("showdown"),
    )


def actions_rows(chunks: DataFrame) -> DataFrame:
    """One row per action, as those operators read actions: hand_id, ord (from 1, by numeric action id), street and
    action_type trimmed in lower case, seat (-1 where none is told), amount, amount_bb, raise_to, call_to, pot_before,
    pot_after. Missing money is 0, but raise_to and call_to stay null."""
    a = actions_of(chunks)
    word = lambda c: F.lower(F.trim(F.coalesce(c, F.lit("")))).alias(c)
    money = lambda c, name: F.coalesce(F.col(c), F.lit(0.0)).alias(name)
    return a.select(
        F.concat_ws("#", "chunk_id", "hand_idx").alias("hand_id"), "ord", "action_id", word("street"), word("action_type"), F.coalesce("actor_seat", F.lit(-1)).alias("seat"),
        money("amount", "amount"), money("normalized_amount_bb", "amount_bb"), "raise_to", "call_to", money("pot_before", "pot_before"), money("pot_after", "pot_after"),
    )


def players_of(chunks: DataFrame) -> DataFrame:
    """hand_id, nth, seat (of seat, else of a ``seat_N`` identifier, else 0), stack, player_uid, visible (whether hole cards
    are told) and showed."""
    p = _hands(chunks).select("hand_id", F.posexplode("hand.players").alias("nth", "p"))
    seat = F.coalesce(F.nullif(F.col("p.seat"), F.lit(0)), seat_of_uid("p.player_uid"))
    return p.select("hand_id", "nth", seat.alias("seat"), F.coalesce("p.starting_stack", F.lit(0.0)).alias("stack"), "p.player_uid", F.coalesce(F.size("p.hole_cards") > 0, F.lit(False)).alias("visible"), _filled(F.col("p.showed_hand"), False).alias("showed"))


def streets_of(chunks: DataFrame) -> DataFrame:
    """hand_id, nth, street."""
    s = _hands(chunks).select("hand_id", F.posexplode("hand.streets").alias("nth", "s"))
    return s.select("hand_id", "nth", F.coalesce("s.street", "s.name", F.lit("")).alias("street"))


def load_benchmark(spark: SparkSession, path: str, *, ratio: float = 0.15, seed: int = 44, glob: str = "*.json*") -> DataFrame:
    """Labelled chunks with split train or validation: the file's own splits where it has both; else the rows are dealt by
    a hash of their id and ``seed``. Chunks without a label are left out. No training or no validation rows are an error."""
    chunks = read_chunks(spark, path, glob=glob).where("label is not null")
    told = chunks.agg(F.count_if(F.col("split") == "train").alias("t"), F.count_if(F.col("split") == "validation").alias("v")).first()
    if not (told["t"] and told["v"]):
        chunks = hash_split(chunks.drop("split"), "chunk_id", ratio, seed)
    sizes = chunks.agg(F.count_if(F.col("split") == "train").alias("train"), F.count_if(F.col("split") == "validation").alias("validation")).first().asDict()
    if not all(sizes.values()):
        raise ValueError(f"no {min(sizes, key=sizes.get)} samples found")
    return chunks


def load_samples(spark: SparkSession, path: str, *, mode: str = "auto", glob: str = "*.json*") -> DataFrame:
    """Chunks to be evaluated or scored. ``labelled`` keeps those with a label, ``raw`` all, with label -1 where there is
    none; ``auto`` is labelled if any chunk has a label."""
    chunks = read_chunks(spark, path, glob=glob)
    if mode == "auto":
        mode = "labelled" if is_labelled(chunks).first()["some"] else "raw"
    return chunks.where("label is not null") if mode == "labelled" else chunks.withColumn("label", F.coalesce("label", F.lit(-1)))
