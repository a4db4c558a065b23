"""Held-out evaluation texts inside a corpus, by template windows.

Words of items and documents are made templates alike: numbers, names and units become typed placeholders.
Windows of the templates meet by hash; that finds verbatim passages and re-parameterised ones. The slots of a
meeting then decide: equal slots mean a verbatim passage; slots that one consistent renaming turns into the
item's mean a re-parameterised one.

A number is a word of digits, a unit the word behind a number. What is a name depends on the question. Verbatim passages may
differ from the item in case and marks, so there the names are the words that the items themselves write with a capital,
however many these are. Where a name may have been exchanged for one that no
item has, a name is told by its own form: a capital inside a sentence.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from marketloom.session import materialize

#: Words in a window, and how many of them at least are no placeholders where names may be exchanged.
WINDOW, LEAST_LITERAL = 12, 6
#: Most windows of items, or documents with a meeting, that are broadcast; more are joined by shuffle.
BROADCAST_WINDOWS, BROADCAST_DOCS = 200_000, 200_000
#: Most names of items that a task holds; more meet the words by shuffle.
MOST_NAMES = 50_000
_NUMBER, _UNIT, _NAME = "\u0001n", "\u0001u", "\u0001p"
#: Rows with the arrays w and t, of words and their placeholders, in place of their body; their first column is a key.
Typing = Callable[[DataFrame], DataFrame]


def words(text: Column) -> Column:
    """Runs of letters and digits, lower case."""
    return F.regexp_extract_all(F.lower(text), F.lit(r"([\p{L}\p{N}]+)"), 1)


def _names(items: DataFrame, text: str) -> DataFrame:
    """(name): the words that items write with a capital inside a sentence, lower case."""
    found = F.regexp_extract_all(F.col(text), F.lit(r"(?<=[\p{Ll}\p{N},;] )(\p{Lu}[\p{L}]+)"), 1)
    return items.select(F.explode(found).alias("name")).select(F.lower("name").alias("name")).distinct()


def names_of(items: DataFrame, text: str) -> list[str] | None:
    """The words that items write with a capital inside a sentence, lower case; None where a task cannot hold them."""
    rows = _names(items, text).limit(MOST_NAMES + 1).collect()
    return sorted(row[0] for row in rows) if len(rows) <= MOST_NAMES else None


def _is_number(word: Column) -> Column:
    """Whether a word is of digits only. Most words begin with a to z, and are none without a closer look."""
    return ((word < ":") | (word > "{")) & word.rlike(r"^\p{N}+$")


def _in_place(typed: Callable[[Column], Column]) -> Typing:
    """Typing by an expression of the text. The array of a generator is a barrier: words are found and typed once."""

    def of(rows: DataFrame) -> DataFrame:
        held = [c for c in rows.columns if c != "body"]
        return rows.select(*held, F.explode(typed(F.col("body"))).alias("x")).select(*held, "x.w", "x.t")

    return of


def _freely(text: Column, is_name: Callable[[Column, Column], Column] | None) -> Column:
    """Typing without regard to case and marks; is_name tells a name by the word and its place."""

    def one(x: Column, i: Column) -> Column:
        kind = F.when(_is_number(x), _NUMBER)
        return (kind.when(is_name(x, i), _NAME) if is_name else kind).otherwise(x)

    def with_units(listed: Column) -> Column:
        return F.transform(listed, lambda x, i: F.when((F.get(listed, i - 1) == _NUMBER) & (x != _NUMBER), _UNIT).otherwise(x))

    # Arrays of one element name what is found, so that it is found once and not for each use.
    return F.flatten(F.transform(F.array(words(text)), lambda w: F.transform(F.array(F.transform(w, one)), lambda t: F.struct(w.alias("w"), with_units(t).alias("t")))))


def typed_freely(names: list[str]) -> Typing:
    """Typing without regard to case and marks, with names that a task holds."""
    return _in_place(lambda text: _freely(text, (lambda x, _: x.isin(*names)) if names else None))


def typed_by_join(names: DataFrame) -> Typing:
    """As ``typed_freely``, with any number of names, (name): words meet them by shuffle, and come back as the places of the
    names in each text. Texts are told apart by key and digest, so repeated rows and keys do no harm."""

    def of(rows: DataFrame) -> DataFrame:
        key, rows = rows.columns[0], rows.withColumn("__row", F.unhex(F.md5("body")))
        each = rows.select(key, "__row", F.posexplode(words(F.col("body"))).alias("at", "name")).where(F.length("name") > 1)
        places = each.join(names, "name", "left_semi").groupBy(key, "__row").agg(F.array_sort(F.collect_set("at")).alias("__at"))
        told = F.transform("__at", lambda x, i: F.concat(F.array_repeat(F.lit(False), x - F.coalesce(F.get("__at", i - 1), F.lit(-1)) - 1), F.array(F.lit(True))))
        # One flag for each word up to the last name, made once for each text.
        flagged = rows.join(places, [key, "__row"], "left").select(*rows.columns, F.explode(F.array(F.flatten(told))).alias("__named"))
        return _in_place(lambda text: _freely(text, lambda _, i: F.get("__named", i)))(flagged.drop("__row")).drop("__named")

    return of


def _by_form(text: Column) -> Column:
    """Typing by the words' own form: (w, t) arrays of words and their placeholders. A capital is a name's unless a mark that
    ends a sentence, a line or nothing stands before it, or all letters are capitals."""
    marked = F.regexp_extract_all(text, F.lit(r"([\p{L}\p{N}]+|[.!?:\r\n])"), 1)

    def of(listed: Column) -> Column:
        def one(x: Column, i: Column) -> Column:
            before = F.get(listed, i - 1)
            inside = before.isNotNull() & before.rlike(r"^[\p{L}\p{N}]")
            kind = F.when(_is_number(x), _NUMBER).when(x.rlike(r"^\p{Lu}\p{L}*\p{Ll}") & inside, _NAME).when(_is_number(before), _UNIT)
            return F.struct(F.lower(x).alias("w"), kind.otherwise(F.lower(x)).alias("t"))

        kept = F.filter(F.transform(listed, one), lambda x: x["w"].rlike(r"^[\p{L}\p{N}]"))
        return F.transform(F.array(kept), lambda k: F.struct(F.transform(k, lambda x: x["w"]).alias("w"), F.transform(k, lambda x: x["t"]).alias("t")))

    return F.flatten(F.transform(F.array(marked), of))


typed_by_form = _in_place(_by_form)


def _placed(typed: DataFrame, size: int) -> DataFrame:
    """Each window's place (at) and hash (h) beside the columns given. Every word is hashed once, not for each of its windows."""
    hashed = typed.select("*", F.explode(F.array(F.transform("t", lambda x: F.xxhash64(x)))).alias("__k"))
    each = F.transform(F.sequence(F.lit(0), F.size("__k") - size), lambda i: F.struct(i.alias("at"), F.xxhash64(F.slice(F.col("__k"), i + 1, size)).alias("h")))
    return hashed.select(*typed.columns, F.explode(each).alias("x"))


def _meetings(docs: DataFrame, items: DataFrame, typing: Typing, size: int, literal: int) -> DataFrame:
    """(doc, item, shift, asked, said) of each window of a document and of an item with the same template; windows of one
    passage have one shift.

    docs: (doc, body); items: (item, body). Windows travel as hashes; words are only looked at again in documents that
    have a meeting, so nothing but a place and a hash is made for every window.
    """
    own = _placed(typing(items).where(F.size("w") >= size), size)
    own = own.select("item", "x.h", F.col("x.at").alias("begin"), F.slice("w", F.col("x.at") + 1, F.lit(size)).alias("asked"), F.slice("t", F.col("x.at") + 1, F.lit(size)).alias("t"))
    literals = F.size(F.filter("t", lambda x: ~x.startswith("\u0001")))
    wanted = materialize(own.where(literals >= literal).distinct())
    few = wanted.count() <= BROADCAST_WINDOWS
    hashes = wanted.select("h").distinct()
    each = _placed(typing(docs).where(F.size("w") >= size).drop("w"), size).select("doc", "x.at", "x.h")
    hits = materialize(each.join(F.broadcast(hashes) if few else hashes, "h", "left_semi").distinct())
    places = hits.groupBy("doc").agg(F.collect_list(F.struct("at", "h")).alias("hits"))  # at most as many as the document has words
    again = docs.join(F.broadcast(places) if hits.count() <= BROADCAST_DOCS else places, "doc")
    found = typing(again).select("doc", "w", "t", F.explode("hits").alias("hit"))
    cut = lambda c: F.slice(c, F.col("hit.at") + 1, F.lit(size))
    said = found.where(F.col("hit.at") + size <= F.size("w")).select("doc", F.col("hit.at").alias("at"), F.col("hit.h").alias("h"), cut("w").alias("said"), cut("t").alias("t"))
    # The templates themselves decide, not their hashes; another text of the same document id may have others.
    met = said.join(F.broadcast(wanted) if few else wanted, ["h", "t"])
    return met.select("doc", "item", (F.col("at") - F.col("begin")).alias("shift"), "asked", "said")


def _judged(met: DataFrame, doc_id: str, item_id: str) -> DataFrame:
    """verbatim: some window has equal words; consistent: the windows of some passage, taken together, rename one to one."""
    met = materialize(met)
    said = met.select("doc", "item", "shift", F.explode(F.arrays_zip("asked", "said")).alias("p")).select("doc", "item", "shift", "p.asked", "p.said").distinct()
    passages = said.groupBy("doc", "item", "shift").agg(F.count("*").alias("n"), F.count_distinct("asked").alias("a"), F.count_distinct("said").alias("s"))
    renamed = passages.groupBy("doc", "item").agg(F.bool_or((F.col("n") == F.col("a")) & (F.col("n") == F.col("s"))).alias("consistent"))
    equal = met.groupBy("doc", "item").agg(F.bool_or(F.col("asked") == F.col("said")).alias("verbatim"))
    return equal.join(renamed, ["doc", "item"]).select(F.col("doc").alias(doc_id), F.col("item").alias(item_id), "verbatim", "consistent")


def leaked_passages(docs: DataFrame, doc_id: str, text: str, items: DataFrame, item_id: str, item_text: str, size: int = WINDOW) -> DataFrame:
    """(doc_id, item_id, verbatim, consistent) of each document and item that share a template window.

    verbatim: some window has the item's very words, in order (case, blanks and marks do not matter).
    consistent: some passage turns into the item's by one renaming of its slots, one to one. Null, empty
    and short texts share nothing; repeated rows and items give one row. The names are the items' own, so the
    placeholders of a document never depend on other documents.
    """
    docs = docs.select(F.col(doc_id).alias("doc"), F.col(text).alias("body"))
    items = items.select(F.col(item_id).alias("item"), F.col(item_text).alias("body"))
    names = names_of(items, "body")
    typing = typed_freely(names) if names is not None else typed_by_join(materialize(_names(items, "body")))
    return _judged(_meetings(docs, items, typing, size, 0), doc_id, item_id)


def reparameterised_passages(docs: DataFrame, doc_id: str, text: str, items: DataFrame, item_id: str, item_text: str, size: int = WINDOW) -> DataFrame:
    """(doc_id, item_id, verbatim, consistent) as ``leaked_passages``, but with names told by their own form, so that a name
    which no item has may stand in for an item's. Windows with fewer than ``LEAST_LITERAL`` words that are no placeholders
    say too little and are left out. Null, empty and short texts share nothing."""
    docs = docs.select(F.col(doc_id).alias("doc"), F.col(text).alias("body"))
    items = items.select(F.col(item_id).alias("item"), F.col(item_text).alias("body"))
    return _judged(_meetings(docs, items, typed_by_form, size, LEAST_LITERAL), doc_id, item_id)
