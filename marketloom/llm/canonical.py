"""Free-entered values to the entries of a reference list.

Each distinct token is repaired: it meets the reference's vocabulary in the symmetric-delete index, by edit
distance; abbreviations meet it by their prefix or their consonants; words run together meet it as compounds of
neighbouring words of a label, words broken in pieces as runs of neighbouring tokens. The corrected tokens of a value then
rank the complete entries by soft TF-IDF. Values come as often as people typed them, so everything but the last join works
on distinct values. The reference list is the only thing held in a task; its size is checked.
"""

from __future__ import annotations

import math
import re
from collections import defaultdict
from collections.abc import Iterator
from itertools import combinations

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from marketloom.llm.spelling import fold, folded, near_pairs
from marketloom.operators.packed import BLANKS
from marketloom.session import materialize

#: Least soft TF-IDF of an accepted entry, and its least lead over any other entry.
ACCEPT, LEAD = 0.72, 0.03
#: Most neighbouring tokens that are tried as one word that was broken; share of its likeness that a word broken or run together keeps.
MOST_BROKEN, BROKEN = 3, 0.97
_VOWELS = frozenset("aeiouy")
#: Most labels of a reference list.
MOST_LABELS = 100_000
# Marks that stand for words.
SIGNS = ((r"\+\s*/\s*-", " powyżej poniżej "), (r"&", " i "), (r"%", " procent "))
_TOKEN = r"([\p{L}\p{N}]+\.?)"


def _tokens(text: Column) -> Column:
    """Folded tokens; a point behind a token stays, as it may tell an abbreviation."""
    for mark, said in SIGNS:
        text = F.regexp_replace(text, mark, said)
    return F.regexp_extract_all(folded(text), F.lit(_TOKEN), 1)


def _label_tokens(label: str) -> list[str]:
    for mark, said in SIGNS:
        label = re.sub(mark, said, label)
    return re.findall(r"[^\W_]+", fold(label))


class Reference:
    """The labels of one kind: their words, weights, and labels by word.

    A compound is several neighbouring words of a label run together; it stands for these words.
    """

    def __init__(self, labels: list[tuple[int, str]]):
        self.labels = [(ref, _label_tokens(label)) for ref, label in labels]
        self.labels = [(ref, tokens) for ref, tokens in dict.fromkeys((r, tuple(t)) for r, t in self.labels) if tokens]
        entries = defaultdict(set)
        self.holders = defaultdict(set)
        self.compounds: dict[str, set[tuple[str, ...]]] = defaultdict(set)
        for i, (ref, tokens) in enumerate(self.labels):
            for t in tokens:
                entries[t].add(ref)
                self.holders[t].add(i)
            for a in range(len(tokens)):
                for b in range(a + 2, len(tokens) + 1):
                    self.compounds["".join(tokens[a:b])].add(tokens[a:b])
        n = len({ref for ref, _ in self.labels})
        self.idf = {t: math.log(1 + n / len(refs)) for t, refs in entries.items()}
        self.unknown = math.log(1 + n)
        self.prefixes, self.skeletons = defaultdict(list), defaultdict(list)
        for word in sorted(self.idf):
            for k in range(1, len(word)):
                self.prefixes[word[:k]].append(word)
            for k in range(1, 4):
                for rest in {"".join(c) for c in combinations(word[1:], k)}:
                    if not set(word[0] + rest) & _VOWELS:
                        self.skeletons[word[0] + rest].append(word)

    def rank(self, tokens: list[str], near: dict[str, list[tuple[str, float]]]) -> int:
        """The entry that the tokens mean, or 0."""
        units = self._units(tokens, near)
        candidates = {i for words, *_ in units for i in set.intersection(*(self.holders[t] for t in words))}
        scores: dict[int, float] = {}
        for i in candidates:
            ref, label = self.labels[i]
            scores[ref] = max(scores.get(ref, 0.0), self._soft(units, len(tokens), label))
        best = sorted(scores.items(), key=lambda x: (-x[1], x[0]))[:2]
        if not best or best[0][1] < ACCEPT or (len(best) > 1 and best[0][1] - best[1][1] < LEAD):
            return 0
        return best[0][0]

    def _units(self, tokens: list[str], near: dict[str, list[tuple[str, float]]]) -> list[tuple[tuple[str, ...], float, int, int]]:
        """(words, likeness, begin, end): the label words that each token, or several neighbours run together, may stand for."""
        out: dict[tuple[tuple[str, ...], int, int], float] = {}

        def add(words: tuple[str, ...], s: float, a: int, b: int) -> None:
            out[words, a, b] = max(s, out.get((words, a, b), 0.0))

        for a, b, said in _spans(tokens):
            for met, s in [(said, 1.0), *near.get(said, ())]:
                if met in self.idf and b == a + 1:
                    add((met,), s, a, b)
                elif met in self.idf:
                    add((met,), s * BROKEN, a, b)
                for words in self.compounds.get(met, ()):
                    add(words, s * BROKEN, a, b)
        for a, token in enumerate(tokens):
            bare, known = token.rstrip("."), any(x == a and y == a + 1 and len(w) == 1 for w, x, y in out)
            if token.endswith(".") or (not known and len(bare) >= 3):
                for word in self.prefixes.get(bare, ()):
                    add((word,), 0.9 if token.endswith(".") else 0.6, a, a + 1)
                    known = True
            if not known and 2 <= len(bare) <= 4:
                for word in self.skeletons.get(bare, ()):
                    add((word,), 0.8, a, a + 1)
        return [(words, s, a, b) for (words, a, b), s in out.items()]

    def _soft(self, units: list[tuple[tuple[str, ...], float, int, int]], count: int, label: tuple[str, ...]) -> float:
        """Cosine of the two weighted token lists, a match weighing as much as it is alike. Each token of either side is
        used once; of all ways to do so the best counts."""
        at = defaultdict(list)
        for m in range(len(label)):
            for words, s, a, b in units:
                if label[m : m + len(words)] == words:
                    at[a].append((b, m, len(words), s, sum(self.idf[t] ** 2 for t in words)))
        # (used label words, tokens without a match) -> best product, after each token of the value
        states: list[dict[tuple[int, int], float]] = [{} for _ in range(count + 1)]
        states[0][0, 0] = 0.0
        for k in range(count):
            for (used, left), dot in states[k].items():
                ways = [(k + 1, used, left + 1, dot)]
                for b, m, n, s, weight in at[k]:
                    bits = (1 << n) - 1 << m
                    if not used & bits:
                        ways.append((b, used | bits, left, dot + s * weight))
                for b, u, n, d in ways:
                    if d > states[b].get((u, n), -1.0):
                        states[b][u, n] = d
        weight = [self.idf[t] ** 2 for t in label]
        size, best = math.sqrt(sum(weight)), 0.0
        for (used, left), dot in states[count].items():
            own = sum(w for m, w in enumerate(weight) if used >> m & 1) + left * self.unknown**2
            best = max(best, dot / (math.sqrt(own) * size) if own else 0.0)
        return best


def _spans(tokens: list[str]) -> Iterator[tuple[int, int, str]]:
    """(begin, end, text) of each token and of each run of up to ``MOST_BROKEN`` neighbours, without their points."""
    for a in range(len(tokens)):
        for b in range(a + 1, min(len(tokens), a + MOST_BROKEN) + 1):
            yield a, b, "".join(t.rstrip(".") for t in tokens[a:b])


def map_to_reference(values: DataFrame, reference: DataFrame) -> DataFrame:
    """(kind, text, ref_id) of each distinct value (kind, text); ref_id is 0 where no entry is meant.

    reference: (kind, ref_id, label), one row for each spelling of an entry. Null and blank values are left
    out. A value of marks only, and one whose best entries tie, mean no entry. An empty reference list
    gives 0 for every value. Values of a kind that the list does not have give 0.
    """
    labels = reference.where("label is not null").select("kind", "ref_id", "label").distinct().limit(MOST_LABELS + 1).collect()
    if len(labels) > MOST_LABELS:
        raise ValueError(f"the reference list has more than {MOST_LABELS} labels")
    by_kind: dict[str, list[tuple[int, str]]] = defaultdict(list)
    for kind, ref, label in sorted(labels):
        by_kind[kind].append((ref, label))
    known = {kind: Reference(rows) for kind, rows in by_kind.items()}
    distinct = values.where(F.length(F.btrim("text", F.lit(BLANKS))) > 0).select("kind", "text").distinct()
    tokens = distinct.select("kind", "text", F.explode(F.array(_tokens(F.col("text")))).alias("tokens"))
    bare = F.transform("tokens", lambda t: F.rtrim(t, F.lit(".")))
    span = lambda i, n: F.when(i + n <= F.size("tokens"), F.concat_ws("", F.slice(bare, i + 1, n)))
    at = F.sequence(F.lit(0), F.greatest(F.size("tokens") - 1, F.lit(0)))
    spans = F.array_distinct(F.array_compact(F.flatten(F.transform(at, lambda i: F.array(*[span(i, n) for n in range(1, MOST_BROKEN + 1)])))))
    # Distinct values are few against the rows they come from, which are read once.
    spanned = materialize(tokens.select("kind", "text", "tokens", F.explode(F.array(spans)).alias("spans")))
    asked = spanned.select("kind", "text", "tokens", F.explode("spans").alias("a")).where(F.char_length("a") >= 4)
    spark = values.sparkSession
    vocabulary = sorted({(kind, w) for kind, ref in known.items() for w in [*ref.idf, *ref.compounds]})
    near = near_pairs(asked.select("kind", F.col("a").alias("word")).distinct(), spark.createDataFrame(vocabulary, "kind string, word string"), "word", "kind", two_from=6)
    near = near.where(F.col("edits") > 0).groupBy("kind", "a").agg(F.collect_list(F.struct("b", "edits")).alias("near"))
    repairs = asked.select("kind", "text", "a").join(near, ["kind", "a"]).groupBy("kind", "text").agg(F.collect_list(F.struct("a", "near")).alias("near"))
    lists = spanned.select("kind", "text", "tokens").join(repairs, ["kind", "text"], "left")

    def ranked(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            out = []
            for kind, text, toks, near in zip(frame["kind"], frame["text"], frame["tokens"], frame["near"], strict=True):
                out.append((kind, text, _meant(known.get(kind), list(toks), near)))
            yield pd.DataFrame(out, columns=["kind", "text", "ref_id"])

    return lists.mapInPandas(ranked, "kind string, text string, ref_id bigint")


def _meant(reference: Reference | None, tokens: list[str], near) -> int:
    if reference is None or not tokens:
        return 0
    edits = {row["a"]: [(n["b"], 1 - int(n["edits"]) / max(len(row["a"]), len(n["b"]))) for n in row["near"]] for row in (() if near is None else near)}
    return reference.rank(tokens, edits)
