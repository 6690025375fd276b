"""Benchmark contamination by template canonicalisation, in DataFrame functions only.

Texts become sequences of tokens in which numbers, names (capitalised words) and units are replaced by typed
placeholders; the values they replaced are the slots. Windows of five template tokens are hashed and joined with the
benchmark's; a bit array of the benchmark's hashes, of fixed size, leaves the other windows of a text out beforehand.
An item that covers at least `similarity` of its windows in a text has at least one of its rarest windows there, so
those alone find candidates. There hits are gathered by text, item and diagonal (text position minus item position).
Windows of nothing but placeholders, which number tables are full of, are all alike: they count where their slots are
identical, and else only on diagonals where a window with a word has met its own, so that n numbers never meet n others.
In a diagonal each slot value of the item stands for one value of the text, the one it has in most windows; windows with
another value are dropped, but windows whose slots are identical always count. A verbatim passage maps every value on
itself; a question asked again with other numbers or names may give two of them the same new value. A text holds an item
if what is left covers at least `similarity` of the item's windows.
"""

from __future__ import annotations

import json
from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from kelpforge.llm._common import ROW, empty_if_null, free_name, settle, with_row_key

WINDOW = 5
SIMILARITY = 0.8
#: Items shorter than a window are found inside longer texts word for word; those below this length only as whole texts.
LEAST_TOKENS = 3
#: Words of 64 bits, at least and at most, in the array that says which window hashes the benchmark has; else 16 bits a hash.
_BIT_WORDS = 1 << 4, 1 << 14
#: Windows of the benchmark up to which its side of the join is broadcast; above, both sides are shuffled by hash.
BROADCAST_WINDOWS = 1_000_000
#: Words that count as units.
UNITS = (
    "mm cm dm m km mg g kg t ml cl l s ms min h hz khz mhz ghz w kw v a pa kpa mph kmh usd eur gbp % ° $ € £ inch inches foot feet yard yards mile miles "
    "metre metres meter meters kilometre kilometres kilometer kilometers gram grams kilogram kilograms ounce ounces pound pounds litre litres liter liters "
    "second seconds minute minutes hour hours day days week weeks month months year years dollar dollars euro euros cent cents percent degree degrees"
).split()
_NAME = "\x01"
_SLOT_END = "\x02"
_BECOMES = "\x03"


def tokens(text: Column) -> Column:
    """Lower-case words, numbers (ASCII digits) and unit signs; what was a capitalised word has a mark before it."""
    plain = F.regexp_replace(empty_if_null(text), f"[{_NAME}{_SLOT_END}{_BECOMES}]", " ")
    marked = F.regexp_replace(plain, r"\p{Lu}(?<!\p{L}\p{Lu})\p{Ll}+", _NAME + "$0")
    return F.regexp_extract_all(F.lower(marked), F.lit(_NAME + r"?[\p{L}\p{M}]+|[0-9]+(?:[.,][0-9]+)*|[%°$€£]"), F.lit(0))


def _kind(token: str) -> str:
    """SQL for the kind of a token in lower case; by order, for a mark sorts before all and digits sort between 0 and :."""
    units = ", ".join(f"'{u}'" for u in UNITS)
    return f"CASE WHEN {token} < '{_SLOT_END}' THEN '#name' WHEN {token} < ':' AND {token} >= '0' THEN '#number' WHEN {token} IN ({units}) THEN '#unit' END"


def _bare(token: str) -> str:
    return f"ltrim('{_NAME}', {token})"


@dataclass(frozen=True)
class HashBits:
    """Which hashes there may be, as a bit array: bit h mod 64 of word h / 64 mod the number of words, a power of two."""

    words: tuple[int, ...]

    @staticmethod
    def place(hashed: Column, n: int) -> tuple[Column, Column]:
        return F.shiftrightunsigned(hashed, 6).bitwiseAND(F.lit(n - 1)).cast("int"), hashed.bitwiseAND(F.lit(63)).cast("int")

    @classmethod
    def of(cls, items: DataFrame) -> HashBits:
        """The driver gets as many numbers as there are words. Beyond the largest array more hashes pass, but none is left out."""
        n = min(max(1 << (items.count() // 4).bit_length(), _BIT_WORDS[0]), _BIT_WORDS[1])
        word, bit = cls.place(F.col("hash"), n)
        found = items.select(word.alias("word"), F.call_function("shiftleft", F.lit(1).cast("long"), bit).alias("bit")).groupBy("word").agg(F.bit_or("bit").alias("bits")).collect()
        words = [0] * n
        for r in found:
            words[r["word"]] = r["bits"]
        return cls(tuple(words))

    def may_hold(self, hashed: str) -> str:
        """SQL for whether a hash may be among them."""
        words = f"from_json('{json.dumps(self.words)}', 'array<bigint>')"
        return f"(shiftright(get({words}, CAST(shiftrightunsigned({hashed}, 6) & {len(self.words) - 1} AS int)), CAST({hashed} & 63 AS int)) & 1) = 1"


def windows(texts: DataFrame, widths: Sequence[int], bits: HashBits | None = None, whole_only: bool = False) -> DataFrame:
    """The columns of texts (among them text) but text, with at, hash, slots, alone: windows of template tokens, of each width.

    slots joins what a window's placeholders replaced, each with its kind; alone says whether the window is the whole text.
    Windows with names come twice, the second time with the names as plain words, so that a copy in other case still meets
    them. bits leaves out windows whose hash it does not have; whole_only, and widths under LEAST_TOKENS, take windows that
    are whole texts alone.
    """
    own = [f"`{c}`" for c in texts.columns if c != "text"]
    marked = f"t < '{_SLOT_END}'"
    split = texts.select(*own, tokens(F.col("text")).alias("tokens")).selectExpr(*own, "tokens", f"transform(tokens, t -> {_kind('t')}) AS kinds")
    split = split.selectExpr(
        *own, "tokens", "kinds", "size(tokens) AS n", "zip_with(tokens, kinds, (t, k) -> xxhash64(coalesce(k, t))) AS codes",
        f"array_compact(transform(tokens, (t, i) -> CASE WHEN {marked} THEN i END)) AS names",
    )
    # Names are few, so windows with one are counted from where names stand, and only names are read again as plain words.
    bare_word = f"{_kind(_bare('t'))}, {_bare('t')}"
    split = split.selectExpr(
        *own, "tokens", "kinds", "n", "codes", "size(names) > 0 AS named",
        f"CASE WHEN size(names) > 0 THEN zip_with(tokens, codes, (t, c) -> CASE WHEN {marked} THEN xxhash64(coalesce({bare_word})) ELSE c END) END AS bare_codes",
        *(f"CASE WHEN n >= {w} THEN array_distinct(flatten(transform(names, p -> sequence(greatest(p - {w - 1}, 0), least(p, n - {w}))))) END AS starts_{w}" for w in widths),
    )

    def every(width: int, bare: str) -> str:
        """An array of what windows() gives for one width, with names as plain words where bare says so."""
        fits = f"n {'=' if whole_only or width < LEAST_TOKENS else '>='} {width}" + (" AND named" if bare else "")
        starts = f"starts_{width}" if bare else f"sequence(0, n - {width})"
        hashes = f"transform({starts}, i -> xxhash64({width}, {', '.join(f'get({bare}codes, i + {k})' for k in range(width))}))"

        def slot(k: int) -> str:
            token, kind = f"get(tokens, i + {k})", f"get(kinds, i + {k})"
            if bare:
                kind = f"CASE WHEN {token} < '{_SLOT_END}' THEN {_kind(_bare(token))} ELSE {kind} END"
            return f"concat({kind}, {_bare(token)}, '{_SLOT_END}')"  # null where the token is no slot

        told = f"named_struct('at', i, 'hash', h, 'slots', concat_ws('', {', '.join(map(slot, range(width)))}), 'alone', n = {width})"
        wanted = f"CASE WHEN {bits.may_hold('h') if bits else 'true'} THEN {told} END"
        some = f"zip_with({hashes}, {starts}, (h, i) -> {wanted})" if bare else f"transform({hashes}, (h, i) -> {wanted})"
        return f"CASE WHEN {fits} THEN array_compact({some}) ELSE CAST(array() AS {_WINDOWS}) END"

    found = ", ".join(every(w, bare) for w in widths for bare in ("", "bare_"))
    # But for the outer form Spark would infer a filter on the array, and work it out a second time.
    return split.selectExpr(*own, f"inline_outer(concat({found}))").where("hash IS NOT NULL")


_WINDOWS = "array<struct<at:int,hash:bigint,slots:string,alone:boolean>>"


def benchmark_windows(benchmark: DataFrame, item_col: str, text_col: str, window: int) -> DataFrame:
    """item (a key of each row's own), item_id, item_at, hash, item_slots, short, bare, item_windows: what is looked for.

    A shorter item is one window. bare tells that a window of a longer one holds nothing but placeholders.
    """
    asked = settle(benchmark.select(F.monotonically_increasing_id().alias("item"), F.col(item_col).alias("item_id"), F.col(text_col).alias("text")))
    long = windows(asked, [window]).withColumn("short", F.lit(False))
    short = windows(asked, range(1, window), whole_only=True).withColumn("short", F.lit(True))
    bare = ~F.col("short") & (F.regexp_count("slots", F.lit(_SLOT_END)) == window)
    items = settle(long.unionByName(short).select("item", "item_id", F.col("at").alias("item_at"), "hash", F.col("slots").alias("item_slots"), "short", bare.alias("bare")).distinct())
    return settle(items.join(items.groupBy("item").agg(F.countDistinct("item_at").alias("item_windows")), "item"))


def rarest(items: DataFrame, found: DataFrame, similarity: float) -> DataFrame:
    """item, hash of so many places of each item, those with the fewest partners first, that a text which holds it has one."""
    often = found.groupBy("hash").agg(F.count(F.lit(1)).alias("n"))
    asked = items.groupBy("hash").agg(F.count(F.lit(1)).alias("m")).join(often, "hash")
    weighed = items.join(asked, "hash", "left")
    places = weighed.groupBy("item", "item_at", "item_windows").agg(F.sum(F.coalesce(F.col("n") * F.col("m"), F.lit(0))).alias("partners"))
    first = F.row_number().over(Window.partitionBy("item").orderBy("partners", "item_at"))
    needed = F.ceil(F.col("item_windows") * F.lit(similarity) - F.lit(1e-9))
    places = places.withColumn("nth", first).where((F.col("nth") <= F.col("item_windows") - needed + 1) & (F.col("partners") > 0))
    return items.join(places.select("item", "item_at"), ["item", "item_at"], "left_semi").select("item", "hash").distinct()


def _slot_pairs(own: Column, other: Column) -> Column:
    """Which value of the item becomes which of the text, as one string a pair; those are hashed, where structs would be compared."""
    cut = lambda c: F.split(c, _SLOT_END)
    return F.array_distinct(F.zip_with(cut(own), cut(other), lambda a, b: F.concat(a, F.lit(_BECOMES), b)))


def _item_value(pair: Column) -> Column:
    return F.substring_index(pair, _BECOMES, 1)


def _outvoted(diagonals: DataFrame) -> DataFrame:
    """key, item, diagonal, outvoted: pairs whose item value becomes another text value in more windows; of equals itself stays, then the smallest.

    Votes are counted by grouping, and only where a value of the item becomes two.
    """
    votes = F.flatten(F.transform("hits", lambda h: h["pairs"]))
    pairs = F.array_distinct(votes)
    conflict = F.size(pairs) > F.size(F.array_distinct(F.transform(pairs, _item_value)))
    own = ["key", "item", "diagonal"]
    counts = diagonals.where(conflict).select(*own, F.explode_outer(votes).alias("pair")).groupBy(*own, "pair").agg(F.count(F.lit(1)).alias("n"))
    value = F.substring_index("pair", _BECOMES, -1)
    best = Window.partitionBy(*own, _item_value(F.col("pair"))).orderBy(F.desc("n"), _item_value(F.col("pair")) != value, value)
    lost = counts.withColumn("nth", F.row_number().over(best)).where("nth > 1")
    return lost.groupBy(*own).agg(F.collect_set("pair").alias("outvoted"))


def contaminated(
    docs: DataFrame,
    benchmark: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    item_col: str = "item_id",
    item_text_col: str = "text",
    similarity: float = SIMILARITY,
    window: int = WINDOW,
    broadcast_windows: int = BROADCAST_WINDOWS,
) -> DataFrame:
    """doc_id, item_id, matched_windows, item_windows, similarity, verbatim: a row per document and item that it holds.

    verbatim tells whether each of the matched windows stands there with its own slots. Null texts count as empty; texts without tokens, on either
    side, match nothing. Items shorter than a window are one window: inside longer texts they are found word for word,
    below LEAST_TOKENS only as whole texts. Every row is judged for itself; rows with equal ids, repeated ones and those
    without an id among them, that hold an item give one row, the best of them. An empty table on either side gives an
    empty result. Other columns are not read.
    """
    items = benchmark_windows(benchmark, item_col, item_text_col, window)
    small = items.limit(broadcast_windows + 1).count() <= broadcast_windows
    shared = F.broadcast if small else lambda df: df
    texts = docs.select(F.monotonically_increasing_id().alias("key"), F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    found = settle(windows(texts, [window, *_short_widths(benchmark, item_text_col, window)], HashBits.of(items)))
    rare = rarest(items, found, similarity)
    # Windows that a text has over and over are one before they meet the items.
    met = found.select("key", "doc_id", "hash").join(shared(rare.select("hash").distinct()), "hash", "left_semi").distinct()
    candidates = met.join(shared(rare), "hash").select("key", "doc_id", "item").distinct()
    # By window as well as by text, so that a very long text is not one task's work.
    wanted = settle(candidates.join(shared(items.select("item", "hash", "bare").distinct()), "item"))
    # What is wanted grows with the texts that hold something, so it has no bound that would allow a broadcast.
    near = found.drop("doc_id").join(wanted.hint("shuffle_hash"), ["key", "hash"])
    of_item = shared(items.select("item", "hash", "item_at", "item_slots", "short"))
    hits = near.where("NOT bare").join(of_item, ["item", "hash"])
    hits = settle(hits.where(~F.col("short") | F.col("alone") | (F.col("slots") == F.col("item_slots"))).select("key", "item", "item_at", (F.col("at") - F.col("item_at")).alias("diagonal"), "slots", "item_slots"))

    copies = near.where("bare").select("key", "item", "hash", F.col("slots").alias("item_slots")).distinct()
    copied = copies.join(shared(items.where("bare").select("item", "hash", "item_slots", "item_at")), ["item", "hash", "item_slots"])
    copied = copied.select("key", "item", F.col("item_at").alias("place"), F.lit(False).alias("changed"))
    beside = hits.select("key", "item", "diagonal").distinct().join(shared(items.where("bare").select("item", "hash", "item_at", "item_slots")), "item")
    beside = beside.withColumn("at", F.col("item_at") + F.col("diagonal")).hint("shuffle_hash").join(found.select("key", "at", "hash", "slots"), ["key", "at", "hash"])
    hits = hits.unionByName(beside.select(*hits.columns))

    # One diagonal holds each item position once or twice, so what is gathered is bounded by the item's length.
    hit = F.struct(F.col("item_at").alias("place"), (F.col("slots") != F.col("item_slots")).alias("changed"), _slot_pairs(F.col("item_slots"), F.col("slots")).alias("pairs"))
    diagonals = settle(hits.groupBy("key", "item", "diagonal").agg(F.collect_set(hit).alias("hits")))
    judged = diagonals.join(_outvoted(diagonals), ["key", "item", "diagonal"], "left")
    fits = lambda h: ~h["changed"] | F.col("outvoted").isNull() | ~F.arrays_overlap(h["pairs"], F.col("outvoted"))
    places = judged.select("key", "item", F.explode_outer(F.transform(F.filter("hits", fits), lambda h: F.struct(h["place"], h["changed"]))).alias("hit")).where("hit IS NOT NULL")
    matched = places.select("key", "item", "hit.*").unionByName(copied).groupBy("key", "item").agg(
        F.countDistinct("place").alias("matched_windows"), F.countDistinct(F.when(~F.col("changed"), F.col("place"))).alias("same")
    )
    matched = matched.join(shared(items.select("item", "item_id", "item_windows").distinct()), "item").withColumn("verbatim", F.col("same") == F.col("matched_windows"))
    share = F.col("matched_windows") / F.col("item_windows")
    best = F.max(F.struct("matched_windows", "verbatim", "item_windows")).alias("best")
    named = wanted.select("key", "doc_id", "item").distinct().join(matched.where(share >= similarity), ["key", "item"])
    held = named.groupBy("doc_id", "item_id").agg(best).select("doc_id", "item_id", "best.*")
    return held.select("doc_id", "item_id", "matched_windows", "item_windows", share.alias("similarity"), "verbatim")


def _short_widths(benchmark: DataFrame, text_col: str, window: int) -> list[int]:
    """Lengths under a window that items have: window - 1 numbers at most."""
    size = benchmark.select(F.size(tokens(F.col(text_col))).alias("n")).where((F.col("n") > 0) & (F.col("n") < window))
    return sorted(r["n"] for r in size.distinct().collect())


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, text_col: str = "text", **options) -> DataFrame:
    """The rows of docs that hold no item of the benchmark, with their columns.

    Rows are decided one by one, whatever their ids, so a row without an id that holds an item goes. Rows with null or
    empty texts stay, repeated rows are decided alike. No column of docs can clash with a name of this operator's own; an
    empty table on either side leaves docs as they are.
    """
    name = free_name(docs, ROW)
    keyed = with_row_key(docs, name)
    held = contaminated(keyed.select(name, text_col), benchmark, name, text_col, **options).select(F.col("doc_id").alias(name)).distinct()
    return keyed.join(held, name, "left_anti").select(*docs.columns)
