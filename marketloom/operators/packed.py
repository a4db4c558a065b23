"""Several values packed in one text: one value per row, with its position.

Every separator outside quotes is doubtful: it parts two values or belongs to one. A text is therefore a
lattice. Its nodes are its ends and its separators; its arcs are the atoms between two separators next to each other, and
every longer span that the column attests as one value by quoting it somewhere. Frequencies of values
are learned from the whole column by expectation maximisation over all lattices: certain uses (quoted values, and the
values of lattices with a single path) count as they are, the others by their posterior. Viterbi takes the
best path. Quoted spans are atomic. A span that nothing attests has less mass than its atoms in every round, so
leaving its arc out changes no path.

An arc is weighed against the arcs that begin where it begins and against those that end where it ends, by shares of
their frequencies. No number of all rows comes into it: the same text gives the same values in a column of any size.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from marketloom.session import materialize

#: Blanks that are trimmed.
BLANKS = " \t\r\n\u000b\u000c\u00a0\u2007\u202f\u3000"


@dataclass(frozen=True)
class Packing:
    """How a column packs its values. ``separators``: the characters that may separate outside quotes (a blank
    stands for any run of blanks); no other character does. ``brackets``: the text may be a bracketed list."""

    separators: str
    brackets: bool = False


# The separators of the three packed columns.
HEADING_PATH = Packing(">»→|;")
DOM_PATH = Packing(">|/")
RECORD_IDS = Packing(",;| ", brackets=True)

#: Uses that a value is taken to have before any is seen; shared by atoms and joined spans as separators part or do not.
PRIOR_USES = 1.0
#: Share of separators that part values, before learning, and the bounds of what is learned.
PARTING, LEAST_PARTING, MOST_PARTING = 0.9, 0.5, 0.99
#: Learning ends when no frequency moves by more than this share of itself and one, or after so many rounds.
SETTLED, ROUNDS = 1e-2, 12
#: Most attested values of several atoms, and most segmented texts, that are broadcast; more are joined by shuffle.
BROADCAST_ROWS = 100_000


def _any(chars: str) -> str:
    return re.sub(r"([\[\]\\^&-])", r"\\\1", chars)


def _class(how: Packing) -> str:
    return _any(how.separators.replace(" ", BLANKS))


def _bare(text: Column, how: Packing) -> Column:
    return F.regexp_replace(text, r"^\s*\[(.*)\]\s*$", "$1") if how.brackets else text


def blocks(text: Column, how: Packing) -> Column:
    """Array of the trimmed, non-empty atoms between separators; null for null text."""
    # A quote that never closes is an ordinary character. Possessive, so that long texts need no stack.
    found = F.regexp_extract_all(_bare(text, how), F.lit(f'((?:"(?:[^"]++|"")*+"|[^"{_class(how)}]++|")++)'), 1)
    return F.filter(F.transform(found, lambda b: F.btrim(b, F.lit(BLANKS))), lambda b: b != "")


def unquoted(value: Column) -> Column:
    """A value wholly in double quotes without them, its doubled quotes single; any other as it is."""
    inner = F.btrim(F.replace(F.substring(value, 2, F.length(value) - 2), F.lit('""'), F.lit('"')), F.lit(BLANKS))
    whole = value.startswith('"') & value.endswith('"') & (F.length(value) > 1)
    return F.when(whole, F.when(value.rlike(r'^"(?:[^"]++|"")*+"$'), inner).otherwise(value)).otherwise(value)


def _spelled(value: Column, how: Packing) -> Column:
    """A value with its separators in one spelling: no blanks around them, runs of blanks single."""
    marks = _any(how.separators.replace(" ", ""))
    out = F.regexp_replace(value, rf"[{BLANKS}]*([{marks}])[{BLANKS}]*", "$1") if marks else value
    return F.regexp_replace(out, rf"[{BLANKS}]+", " ") if " " in how.separators else out


def spelled(value: str, how: Packing) -> str:
    """As ``_spelled``, of one value."""
    marks = _any(how.separators.replace(" ", ""))
    out = re.sub(rf"[{BLANKS}]*([{marks}])[{BLANKS}]*", r"\1", value) if marks else value
    return re.sub(rf"[{BLANKS}]+", " ", out) if " " in how.separators else out


def atoms(text: str, how: Packing) -> list[tuple[int, int]]:
    """Begin and end of each atom of a text, trimmed."""
    out = []
    for m in re.finditer(rf'(?:"(?:[^"]|"")*"|[^"{_class(how)}]|")+', text):
        found = m[0].strip(BLANKS)
        if found:
            begin = m.start() + len(m[0]) - len(m[0].lstrip(BLANKS))
            out.append((begin, begin + len(found)))
    return out


def _for_kind(how: dict[str, Packing], build) -> Column:
    """The expression of each row's kind."""
    out = F.lit(None)
    for kind, packing in how.items():
        out = F.when(F.col("kind") == kind, build(packing)).otherwise(out)
    return out


def arcs(text: str, known: set[str], how: Packing) -> list[tuple[int, int, str]]:
    """(i, j, span) of a text's lattice: its atoms, and every span of several atoms that is known as a value."""
    at = atoms(text, how)
    starts: dict[str, list[int]] = {}
    for value in known:
        head = spelled(value, how)
        first = atoms(head, how)
        starts.setdefault(head[first[0][0] : first[0][1]], []).append(len(first))
    out = []
    for i, (begin, end) in enumerate(at):
        out.append((i, i + 1, text[begin:end]))
        for n in sorted(set(starts.get(text[begin:end], ()))):
            if n > 1 and i + n <= len(at) and spelled(text[begin : at[i + n - 1][1]], how) in known:
                out.append((i, i + n, text[begin : at[i + n - 1][1]]))
    return out


def _weights(spans: list, parting: float) -> dict[tuple[int, int], float]:
    """Weight of each arc: the mean of its shares among the arcs with its begin and among those with its end."""
    mass = {(e["i"], e["j"]): e["c"] + PRIOR_USES * (parting if e["j"] - e["i"] == 1 else 1 - parting) for e in spans}
    begin: dict[int, float] = {}
    end: dict[int, float] = {}
    for (i, j), m in mass.items():
        begin[i] = begin.get(i, 0.0) + m
        end[j] = end.get(j, 0.0) + m
    return {(i, j): (m / begin[i] * m / end[j]) ** 0.5 for (i, j), m in mass.items()}


def _posteriors(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Expected uses of each arc's value: forward and backward sums over its lattice, rescaled at every node."""
    for frame in frames:
        rows = []
        for kind, times, parting, spans in zip(frame["kind"], frame["times"], frame["parting"], frame["spans"], strict=True):
            w = _weights(spans, parting)
            n = max(j for _, j in w)
            into: dict[int, list] = {}
            out_of: dict[int, list] = {}
            for (i, j), v in w.items():
                into.setdefault(j, []).append((i, v))
                out_of.setdefault(i, []).append((j, v))
            # Products over long texts would underflow: every atom's weight is divided out of all that pass it.
            unit = [w[i, i + 1] for i in range(n)]
            through = [1.0] * (n + 1)
            ratio = {}
            for i, j in w:
                base = 1.0
                for k in range(i, j):
                    base *= unit[k]
                ratio[i, j] = w[i, j] / base
            ahead, back = through[:], through[:]
            for j in range(1, n + 1):
                ahead[j] = sum(ahead[i] * ratio[i, j] for i, _ in into[j])
            for i in range(n - 1, -1, -1):
                back[i] = sum(back[j] * ratio[i, j] for j, _ in out_of[i])
            for e in spans:
                p = ahead[e["i"]] * ratio[e["i"], e["j"]] * back[e["j"]] / ahead[n]
                rows.append((kind, e["span"], times * p, times * p * (e["j"] - e["i"] - 1)))
        yield pd.DataFrame(rows, columns=["kind", "span", "c", "inside"])


def _viterbi(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """The values of each lattice's best path; of equal paths the one with more values."""
    for frame in frames:
        rows = []
        for kind, key, parting, spans in zip(frame["kind"], frame["id"], frame["parting"], frame["spans"], strict=True):
            w, said = _weights(spans, parting), {(e["i"], e["j"]): e["said"] for e in spans}
            n = max(j for _, j in w)
            best: list[tuple[float, int]] = [(1.0, 0)] + [(0.0, 0)] * n
            scale = [1.0] * (n + 1)  # the best path to a node has weight one; what it had is carried in the scale
            by_end: dict[int, list] = {}
            for (i, j), v in w.items():
                by_end.setdefault(j, []).append((i, v))
            for j in range(1, n + 1):
                found = []
                for i, v in by_end[j]:
                    carried = v
                    for k in range(i + 1, j):
                        carried /= scale[k]
                    found.append((carried, i))
                best[j] = max(found)
                scale[j] = best[j][0]
            at, values = n, []
            while at:
                values.append(said[best[at][1], at])
                at = best[at][1]
            rows.append((kind, key, values[::-1]))
        yield pd.DataFrame(rows, columns=["kind", "id", "values"])


def attested_values(rows: DataFrame, how: dict[str, Packing]) -> DataFrame:
    """(kind, value, head, times) of the values of several atoms that quotes hold together: how often each is
    quoted, in one spelling of its separators, and the hash of its first two atoms."""
    quoted = rows.where(F.col("text").contains('"')).select("kind", F.explode(_for_kind(how, lambda p: blocks(F.col("text"), p))).alias("atom"))
    whole = quoted.where(F.col("atom").startswith('"')).select("kind", "atom", unquoted(F.col("atom")).alias("value")).where("value <> atom")
    spelt = whole.select("kind", _for_kind(how, lambda p: _spelled(F.col("value"), p)).alias("value")).groupBy("kind", "value").agg(F.count("*").cast("double").alias("times"))
    parts = spelt.select("kind", "value", "times", F.explode(F.array(_for_kind(how, lambda p: blocks(F.col("value"), Packing(p.separators))))).alias("parts"))
    return parts.where(F.size("parts") > 1).select("kind", "value", F.xxhash64("kind", F.col("parts")[0], F.col("parts")[1]).alias("head"), "times")


def _small(df: DataFrame, count: int) -> DataFrame:
    return F.broadcast(df) if count <= BROADCAST_ROWS else df


def segment_doubtful(rows: DataFrame, how: dict[str, Packing]) -> tuple[DataFrame, int] | None:
    """((kind, id, values), how many) of the distinct texts whose lattices have several paths; None if none has.

    rows: (kind, id, text) of the whole column; id names the text, so that long texts do not travel with each of their arcs.
    """
    known = materialize(attested_values(rows, how))
    kinds = [r["kind"] for r in known.select("kind").distinct().collect()]  # at most as many as the caller named
    if not kinds:
        return None
    how = {k: p for k, p in how.items() if k in kinds}
    size = known.count()
    # Lattices with an attested span are met by the hash of its first two atoms.
    some = rows.where(F.col("kind").isin(*how))
    split = some.select("kind", "id", "text", F.explode(F.array(_for_kind(how, lambda p: blocks(F.col("text"), p)))).alias("atoms")).where(F.size("atoms") > 1)
    pairs = F.zip_with(F.slice("atoms", 1, F.size("atoms") - 1), F.slice("atoms", 2, F.size("atoms") - 1), lambda a, b: F.xxhash64("kind", a, b))
    met = split.select("kind", "id", F.explode(F.array_distinct(pairs)).alias("head")).join(_small(known.select("kind", "head", "value"), size), ["kind", "head"])
    # Rows of one text combine before the shuffle; a value is gathered once for each text that may hold it.
    may = materialize(met.groupBy("kind", "id").agg(F.collect_set("value").alias("known")))
    open_texts = some.join(_small(may, may.count()), ["kind", "id"]).groupBy("kind", "id").agg(F.first("text").alias("text"), F.first("known").alias("known"), F.count("*").cast("double").alias("times"))
    schema = "kind string, id string, times double, i int, j int, span string, said string"

    def spread(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            out = []
            for kind, key, text, values, times in zip(frame["kind"], frame["id"], frame["text"], frame["known"], frame["times"], strict=True):
                bare = re.sub(r"^\s*\[(.*)\]\s*$", r"\1", text, flags=re.S) if how[kind].brackets else text
                found = arcs(bare, set(values), how[kind])
                if any(j - i > 1 for i, j, _ in found):
                    out += [(kind, key, times, i, j, spelled(s, how[kind]), s) for i, j, s in found]
            yield pd.DataFrame(out, columns=["kind", "id", "times", "i", "j", "span", "said"])

    lattice = materialize(open_texts.mapInPandas(spread, schema))
    texts = materialize(lattice.select("kind", "id", "times").distinct())
    n = texts.count()
    if n == 0:
        return None
    # Certain uses: quoted values, and the values of all lattices with a single path.
    wanted = materialize(lattice.select("kind", "span").distinct())
    alone = some.join(_small(texts, n), ["kind", "id"], "left_anti").select("kind", F.explode(_for_kind(how, lambda p: blocks(F.col("text"), p))).alias("atom"))
    in_one = alone.select("kind", _for_kind(how, lambda p: _spelled(unquoted(F.col("atom")), p)).alias("span"))
    uses = in_one.join(_small(wanted, wanted.count()), ["kind", "span"]).groupBy("kind", "span").agg(F.count("*").cast("double").alias("c"))
    fixed = materialize(wanted.join(uses, ["kind", "span"], "left").withColumn("c", F.coalesce("c", F.lit(0.0))))

    def scored(frequencies: DataFrame, parting: dict[str, float]) -> DataFrame:
        share = _for_kind(dict.fromkeys(parting), lambda _: F.lit(None))
        for kind, p in parting.items():
            share = F.when(F.col("kind") == kind, F.lit(p)).otherwise(share)
        arc = F.struct("i", "j", "span", "c", "said")
        return lattice.join(frequencies, ["kind", "span"]).groupBy("kind", "id", "times").agg(F.collect_list(arc).alias("spans")).withColumn("parting", share.cast("double"))

    now, parting = fixed, dict.fromkeys(how, PARTING)
    ends = {r["kind"]: r["n"] for r in texts.groupBy("kind").agg(F.sum("times").alias("n")).collect()}
    for _ in range(ROUNDS):
        expected = materialize(scored(now, parting).select("kind", "times", "parting", "spans").mapInPandas(_posteriors, "kind string, span string, c double, inside double"))
        both = expected.select("kind", "span", "c", F.lit(0.0).alias("before")).unionByName(fixed.withColumn("before", F.lit(0.0)))
        both = both.unionByName(now.select("kind", "span", F.lit(0.0).alias("c"), F.col("c").alias("before")))
        moved = materialize(both.groupBy("kind", "span").agg(F.sum("c").alias("c"), F.sum("before").alias("before")))
        # Of the separators of these lattices, the share that parts values.
        learned = expected.groupBy("kind").agg(F.sum("inside").alias("inside"), F.sum("c").alias("values")).collect()
        parting = {r["kind"]: min(MOST_PARTING, max(LEAST_PARTING, (r["values"] - ends[r["kind"]]) / max(1e-9, r["values"] - ends[r["kind"]] + r["inside"]))) for r in learned}
        settled = moved.where(F.abs(F.col("c") - F.col("before")) > SETTLED * (1 + F.col("before"))).isEmpty()
        now = moved.select("kind", "span", "c")
        if settled:
            break
    found = scored(now, parting).select("kind", "id", "parting", "spans").mapInPandas(_viterbi, "kind string, id string, values array<string>")
    return materialize(found), n


def split_packed(rows: DataFrame, how: dict[str, Packing]) -> DataFrame:
    """(kind, record_id, pos, piece) of rows (kind, record_id, text): one row per value, pos from 1.

    Values are trimmed, empty ones neither given nor counted; a value wholly in quotes comes without
    them. Null, empty and blank texts give no rows. Repeated rows give repeated results, whatever their text; a record
    id that comes twice with different texts gives the values of each. A value that holds a separator comes out whole
    where the column attests it by quoting it and does not use its atoms as values of their own.
    """
    given = rows.where(F.length(F.btrim("text", F.lit(BLANKS))) > 0).select("kind", "record_id", "text")
    single_path = _for_kind(how, lambda p: blocks(F.col("text"), p))
    values = single_path
    named = given.withColumn("id", F.md5("text"))
    if (segmented := segment_doubtful(named.select("kind", "id", "text"), how)) is not None:
        found, n = segmented
        given = named.join(_small(found, n), ["kind", "id"], "left")
        values = F.coalesce("values", single_path)
    clean = F.filter(F.transform(values, unquoted), lambda v: v != "")
    return given.select("kind", "record_id", F.posexplode(clean).alias("pos", "piece")).withColumn("pos", F.col("pos") + 1)
