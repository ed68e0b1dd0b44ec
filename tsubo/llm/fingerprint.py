"""Document fingerprints by order MinHash, with DataFrame functions only.

A text is cut into pieces of at most 8 characters at white space and inside long words; its k-mers are
runs of 3 pieces. The j-th time a k-mer occurs it counts as another k-mer (occurrence number).
One hash sorts all k-mers; its leading bits deal them into 64 slots. In each slot the two smallest
k-mers are kept, put back in text order, and hashed as one tuple. So a slot of two fingerprints
agrees only if the same k-mers stand in the same order, which makes the share of equal slots
follow edit distance rather than set overlap.

Cases: null is the empty text, with an empty fingerprint; a text of fewer than 3 pieces is one k-mer;
two empty texts have likeness 1, an empty and another one 0. Repeated ids are ordered by their text;
null ids come first. With one row, the next document is the row itself. An empty table gives no rows.
Other columns are kept out of the result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

PIECES = 3
SLOT_BITS = 6
PLACE_BITS = 24
ROWS_PER_CHUNK = 1000
MOST_CHUNKS = 16384

_PLACES = (1 << PLACE_BITS) - 1
_PIECE = r"[^\x20\x09-\x0D]{1,8}+"
_GAP = r"[\x20\x09-\x0D]*+"


def _pattern(pieces: int) -> str:
    """Finds every piece and captures the run of pieces that starts there."""
    return f"(?=({_GAP.join([_PIECE] * pieces)})){_PIECE}"


def with_signature(rows: DataFrame, text: str, name: str, pieces: int = PIECES) -> DataFrame:
    """Adds `name`: an array of at most 64 ints, slot number in the upper 6 bits, ascending slots.

    Each step is a column of its own: arrays are looked up by index inside lambdas and must not be
    computed again per element.
    """
    keep, high = [*rows.columns], ~_PLACES
    hashed = F.transform(F.regexp_extract_all(F.col(text), F.lit(_pattern(pieces)), F.lit(1)),
                         lambda s, i: F.xxhash64(s).bitwiseAND(F.lit(high)).bitwiseOR(i.bitwiseAND(F.lit(_PLACES)).cast("bigint")))
    whole = F.when(F.col(text) == "", F.array().cast("array<bigint>")).otherwise(
        F.array(F.xxhash64(text).bitwiseAND(F.lit(high))))
    rows = rows.withColumn("_all", hashed)
    rows = rows.withColumn("_sorted", F.sort_array(F.when(F.size("_all") > 0, F.col("_all")).otherwise(whole))).drop("_all")

    def same(array: str, x: Column, i: Column) -> Column:
        return F.shiftrightunsigned(x.bitwiseXOR(F.get(F.col(array), i - 1)), PLACE_BITS) == 0

    rows = rows.withColumn("_heads", F.filter("_sorted", lambda x, i: (i == 0) | ~same("_sorted", x, i)))
    # later occurrences, if there are any: runs of one k-mer, each numbered from 2
    some = F.size("_heads") < F.size("_sorted")
    rows = rows.withColumn("_more", F.when(some, F.filter("_sorted", lambda x, i: (i > 0) & same("_sorted", x, i))))
    rows = rows.withColumn("_runs", F.when(F.col("_more").isNotNull(), F.filter(
        F.sequence(F.lit(0), F.size("_more") - 1),
        lambda i: (i == 0) | ~same("_more", F.get(F.col("_more"), i), i))))

    def numbered(start: Column, r: Column) -> Column:
        end = F.coalesce(F.get(F.col("_runs"), r + 1), F.size("_more"))
        return F.transform(F.slice("_more", start + 1, end - start), lambda x, o: F.xxhash64(
            F.shiftrightunsigned(x, PLACE_BITS), o).bitwiseAND(F.lit(high)).bitwiseOR(x.bitwiseAND(F.lit(_PLACES))))

    rows = rows.withColumn("_later", F.when(F.col("_runs").isNotNull(), F.flatten(F.transform("_runs", numbered))))
    rows = rows.withColumn("_numbered", F.when(F.col("_later").isNull(), F.col("_heads")).otherwise(
        F.sort_array(F.concat("_heads", "_later"))))
    shift = 64 - SLOT_BITS
    rows = rows.withColumn("_least", F.filter("_numbered", lambda x, i: (i < 2) | (
        F.shiftrightunsigned(x, shift) != F.shiftrightunsigned(F.get(F.col("_numbered"), i - 2), shift))))

    def tuple_hash(x: Column, i: Column) -> Column:
        """The slot's tuple at its first member, null at its second."""
        slot = F.shiftrightunsigned(x, shift)
        before, after = F.get(F.col("_least"), i - 1), F.get(F.col("_least"), i + 1)
        second = (i > 0) & (F.shiftrightunsigned(before, shift) == slot)
        pair = F.shiftrightunsigned(after, shift) == slot
        kmer, other = x.bitwiseAND(F.lit(high)), after.bitwiseAND(F.lit(high))
        ordered = F.when(x.bitwiseAND(F.lit(_PLACES)) <= after.bitwiseAND(F.lit(_PLACES)), F.xxhash64(kmer, other)).otherwise(F.xxhash64(other, kmer))
        value = F.when(pair, ordered).otherwise(F.xxhash64(kmer))
        packed = F.shiftleft(slot, 32 - SLOT_BITS).bitwiseOR(F.shiftrightunsigned(value, 32 + SLOT_BITS))
        return F.when(~second, (packed - F.lit(1 << 31)).cast("int"))

    rows = rows.withColumn(name, F.array_compact(F.transform("_least", tuple_hash)))
    return rows.select(*keep, name)


def likeness(a: str, b: str) -> Column:
    """Equal slots among the slots that either fingerprint fills; 1 for two empty ones."""
    shift = 32 - SLOT_BITS
    slots = [F.transform(x, lambda v: F.shiftrightunsigned(v, shift)) for x in (a, b)]
    filled = F.size(a) + F.size(b) - F.size(F.array_intersect(*slots))
    return F.when(filled == 0, 1.0).otherwise(F.size(F.array_intersect(a, b)) / filled)


def as_text(signature: str) -> Column:
    """A fingerprint as hex words, one per filled slot."""
    return F.array_join(F.transform(signature, lambda v: F.hex(v.cast("bigint").bitwiseAND(F.lit(0xFFFFFFFF)))), " ")


def with_next(rows: DataFrame, columns: list[str], rows_per_chunk: int = ROWS_PER_CHUNK) -> DataFrame:
    """Each row with next_<column> of the next row by (doc_id, text); the last row's next is the first.

    Ids are cut into ranges of about equal size. The first row of a range is also dealt to the
    range before it, so that one shuffle by range puts every row beside its next.
    """
    stats = rows.agg(F.count("*").alias("n"), F.min("doc_id").alias("least"),
                     F.count("doc_id").alias("with_id")).first()
    chunks = min(MOST_CHUNKS, max(1, -(-stats["n"] // rows_per_chunk)))
    bounds: list[int] = []
    if stats["with_id"] and chunks > 1:
        shares = [i / chunks for i in range(1, chunks)]
        found = rows.agg(F.percentile_approx("doc_id", shares, 20 * chunks).alias("b")).first()["b"]
        bounds = sorted({b for b in found if b > stats["least"]})
    # two short searches instead of one long one
    step = max(1, int(len(bounds) ** 0.5))
    coarse = bounds[::step]
    fine = [bounds[i:i + step] for i in range(0, len(bounds), step)]
    if bounds:
        group = F.size(F.filter(F.array(*[F.lit(b).cast("bigint") for b in coarse]), lambda b: b <= F.col("doc_id"))) - 1
        lists = F.array(*[F.array(*[F.lit(b).cast("bigint") for b in x]) for x in fine])
        rows = rows.withColumn("_group", F.when(F.col("doc_id").isNull(), -1).otherwise(group))
        within = F.size(F.filter(F.get(lists, F.col("_group")), lambda b: b <= F.col("doc_id")))
        rows = rows.withColumn("_chunk", F.when(F.col("_group") < 0, 0).otherwise(F.col("_group") * step + within)).drop("_group")
        head = F.array_contains(F.get(lists, F.floor((F.col("_chunk") - 1) / step).cast("int")), F.col("doc_id")) & (F.col("_chunk") > 0)
    else:
        rows, head = rows.withColumn("_chunk", F.lit(0)), F.lit(False)
    first = F.col("doc_id").isNull() if stats["with_id"] < stats["n"] else F.col("doc_id") == F.lit(stats["least"])
    place = lambda chunk, guest: F.struct(chunk.cast("int").alias("_at"), F.lit(guest).alias("_guest"))
    places = F.when(first, F.array(place(F.col("_chunk"), 0), place(F.lit(len(bounds)), 1))).when(
        F.coalesce(head, F.lit(False)), F.array(place(F.col("_chunk"), 0), place(F.col("_chunk") - 1, 1))).otherwise(
        F.array(place(F.col("_chunk"), 0)))
    dealt = rows.select("*", F.inline(places))
    order = W.partitionBy("_at").orderBy("_guest", F.col("doc_id").asc_nulls_first(), "text")
    return dealt.select("*", *[F.lead(c).over(order).alias(f"next_{c}") for c in columns]).where(
        "_guest = 0").drop("_chunk", "_at", "_guest")


def fingerprints(docs: DataFrame, rows_per_chunk: int = ROWS_PER_CHUNK) -> DataFrame:
    """Fingerprints of every text and of its edited form, whose second half is the next text's beginning."""
    rows = docs.select("doc_id", F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    signed = with_signature(rows, "text", "signature")
    rows = with_next(signed, ["text", "signature"], rows_per_chunk)
    half = F.floor(F.length("text") / 2).cast("int")
    edited = F.concat(F.substring("text", F.lit(1), F.length("text") - half), F.substring("next_text", F.lit(1), half))
    rows = rows.select("doc_id", F.length("text").cast("bigint").alias("n_chars"), edited.alias("edited"), "signature", "next_signature")
    rows = with_signature(rows, "edited", "edited_signature")
    return rows.select(
        "doc_id", "n_chars", F.sha2("edited", 256).alias("edited_sha256"),
        as_text("signature").alias("fingerprint"), as_text("edited_signature").alias("edited_fingerprint"),
        likeness("signature", "edited_signature").alias("near_edited"),
        likeness("signature", "next_signature").alias("near_next"))

