"""Variant spellings of people and organisations, linked.

Given names, their short forms and words of clubs that do not tell them apart are listed, and learned from the records' own
paired spellings: a word of which the other spelling has the initial is a given name, one that it drops is a club's.
A name is parsed to a core (family name, or the place of a club), what goes with it (given name or initial, or
the club's side), and the rest, which does not tell anybody apart (legal forms, middle initials). Cores meet in
the symmetric-delete index within the names that can be the same at all; the tokens of two names that meet
are aligned by optimal assignment, initials and short forms being alike to what they may stand for. Every
spelling then points to its best-attested neighbour, and pointers are followed to the end. Classes that meet only
by spellings much less attested than both stay apart, so that two names are not drawn together by a chain of typos.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from marketloom.llm.spelling import fold, folded, near_pairs, osa
from marketloom.session import materialize

# Given names, folded, and their short forms.
GIVEN = {
    "aleksander": ("alek", "olek"), "alexander": ("alex",), "andrzej": ("jedrek",), "anna": ("ania",), "anthony": ("tony",),
    "antonio": ("tonio",), "bartlomiej": ("bartek",), "benjamin": ("ben", "benny"), "carlos": (), "christopher": ("chris", "kit"),
    "daniel": ("dan", "danny"), "david": ("dave",), "dmitri": ("dima", "mitya"), "edward": ("ted", "eddie", "ed"),
    "elizabeth": ("liz", "beth", "betty"), "emile": ("milo",), "fernando": ("nando",), "francisco": ("paco", "pancho"),
    "franciszek": ("franek",), "friedrich": ("fritz",), "giuseppe": ("beppe",), "grzegorz": ("grzesiek", "grzes"), "guadalupe": ("lupe",),
    "haruto": ("haru",), "henrique": ("rique",), "ignacio": ("nacho",), "jakub": ("kuba",), "jan": ("janek",), "johannes": ("hannes",),
    "john": ("jack",), "jose": ("pepe",), "juan": (), "katarzyna": ("kasia",), "krzysztof": ("krzysiek",), "lars": ("lasse",), "ludwig": ("lutz",),
    "malgorzata": ("gosia",), "margaret": ("meg", "peggy", "maggie"), "maria": (), "mateusz": (), "matthias": ("matze",), "maximilian": ("max",),
    "michael": ("mike", "mick"), "michal": ("misiek",), "nicholas": ("nick",), "oscar": (), "patrick": ("pat",), "pawel": (), "peter": ("pete",),
    "piotr": ("piotrek",), "richard": ("dick", "rick"), "robert": ("bob", "rob", "bobby"), "roberto": ("beto",), "samuel": ("sam",),
    "sebastian": ("basti", "seba"), "stanislaw": ("staszek", "stach"), "thomas": ("tom",), "tomasz": ("tomek",), "vitor": (),
    "william": ("bill", "will"), "wojciech": ("wojtek",), "yusuf": (), "zbigniew": ("zbyszek",),
}
# Words of clubs that do not tell them apart, folded.
CLUB_WORDS = frozenset(
    "fc fk ks lks gks sk ac sc sv ts as cf cd ud rks mks zks bks tsv vfl vfb fcm ksj kso lksi tsg afc bsc ssv "
    "football club klub sportowy ludowy towarzystwo sportowe athletic atletico atl sporting real deportivo dep sportverein "
    "united utd albion alb rovers rov wanderers wand academy acad city town county iskra jantar granit orkan meteor".split()
)
# Marks of a club's second, youth and women's sides, and the side they name.
SIDES = {
    "b": "b", "c": "c", "ii": "ii", "iii": "iii", "2": "ii", "rez": "rez", "rezerwy": "rez", "reserves": "rez", "k": "k", "w": "k", "kobiety": "k",
    "women": "k", "ladies": "k", "frauen": "k", "femenino": "k",
} | {f"u{n}": f"u{n}" for n in range(14, 24)}
# Words about scoring that may follow a player's name.
_SCORING = re.compile(r"\s+(?:trafi|strzeli|zdobędzie|zdobedzie|strzelcem|zdobywa|to score|scores|will score|anytime|marca|marcara|trifft)\b.*$")
# Given names of which the initial has a mark, and the initial.
MARKED_INITIALS = {"emile": "é", "oscar": "ó"}
#: Most times that a class's best-attested spelling may be attested as often as the spelling by which it meets another
#: class; beyond that the two are names of their own with a typo between. A ratio, so that the size of the table has no part.
PEAK = 4
#: Most that the tokens of two spellings of one name cost together.
MOST_COST = 0.7
#: What a short form costs that no list has.
SHORT_FORM = 0.35
#: Letters from which cores meet at two edits: none, as clubs of two letters' difference are mostly clubs of their own.
NO_TWO = 1 << 30
#: Most records of one name that are paired in one piece.
PIECE = 1_000

#: Least share of the words met in paired spellings, and fewest cores, with which a word must have been met to be learned. The
#: share bounds how many words are learned, whatever the size of the corpus.
LEARNED_SHARE, LEARNED_CORES = 1e-4, 2
#: Most rows that are broadcast; more are joined by shuffle.
BROADCAST_ROWS = 200_000

_EDGES = " .,;:!?…*-–—_\"'„”“’‘`"


def _less_one(word: str) -> list[str]:
    return [word, *(word[:i] + word[i + 1 :] for i in range(len(word)))]


class Lexicon:
    """Given names with their short forms, and words of clubs that do not tell them apart: listed ones and learned ones."""

    def __init__(self, given: dict[str, tuple[str, ...]], clubs: frozenset[str]):
        self.given, self.clubs = given, clubs
        self._prepare()

    def _prepare(self) -> None:
        self.short = {short: name for name, shorts in self.given.items() for short in shorts} | {name: name for name in self.given}
        self._typos, self._club_typos = {}, {}
        for word in self.short:
            if len(word) >= 4:
                for d in _less_one(word):
                    self._typos.setdefault(d, set()).add(word)
        for word in self.clubs:
            if len(word) >= 5:
                for d in _less_one(word):
                    self._club_typos.setdefault(d, set()).add(word)
        self._known: dict[str, str | None] = {}

    def __getstate__(self):
        return (self.given, self.clubs)

    def __setstate__(self, state) -> None:
        self.given, self.clubs = state
        self._prepare()

    def given_of(self, token: str) -> str | None:
        """The given name that a folded token stands for; its first letter and a point if it may be several."""
        if token not in self._known:
            if len(self._known) > 100_000:
                self._known.clear()
            self._known[token] = self._given_of(token)
        return self._known[token]

    def _given_of(self, token: str) -> str | None:
        if token in self.short:
            return self.short[token]
        if len(token) < 4:
            return None
        near = {w for d in _less_one(token) for w in self._typos.get(d, ()) if osa(token, w, 1) <= 1}
        names = {self.short[w] for w in near}
        if len(names) > 1:  # a first letter is seldom mistyped
            names = {self.short[w] for w in near if w[0] == token[0]} or names
        if len(names) == 1:
            return names.pop()
        return f"{token[0]}." if names and len({n[0] for n in names}) == 1 else None

    def is_club_word(self, token: str) -> bool:
        return token in self.clubs or (len(token) >= 5 and any(osa(token, w, 1) <= 1 for d in _less_one(token) for w in self._club_typos.get(d, ())))

    def with_learned(self, words: list[tuple[str, str, str, int]]) -> Lexicon:
        """This lexicon and what paired spellings show: (kind, word, other, cores), where kind is ``given`` (the other spelling has
        its initial), ``alias`` (it has another word) or ``dropped`` (it has nothing). Listed words, and words that one typo makes
        of a word better attested, are not learned."""
        given, dropped, alias = Counter(), Counter(), Counter()
        for kind, word, other, cores in words:
            if kind == "given":
                given[word] += cores
            elif kind == "dropped":
                dropped[word] += cores
            else:
                alias[word, other] += cores
                given[word] += cores
                given[other] += cores
        names: dict[str, str] = {}
        clubs: set[str] = set()
        taken = Lexicon(self.given, self.clubs)
        for word, cores in sorted((given + dropped).items(), key=lambda x: (-x[1], x[0])):
            if cores < LEARNED_CORES or taken.given_of(word) or taken.is_club_word(word):
                continue
            if dropped[word] > given[word]:
                clubs.add(word)
                taken = taken._also(club=word)
            else:
                names[word] = word
                taken = taken._also(name=word)
        for (a, b), cores in sorted(alias.items(), key=lambda x: (-x[1], x[0])):
            if cores >= LEARNED_CORES and a in names and b in names and (names[a] == a or names[b] == b):
                keep, drop = sorted((names[a], names[b]), key=lambda w: (-given[w], w))
                names = {w: keep if n == drop else n for w, n in names.items()}
        grown = {k: list(v) for k, v in self.given.items()}
        for word, name in names.items():
            grown.setdefault(name, [])
            if word != name:
                grown[name].append(word)
        return Lexicon({k: tuple(v) for k, v in grown.items()}, self.clubs | clubs)

    def _also(self, name: str = "", club: str = "") -> Lexicon:
        """This lexicon with one more word, in place."""
        if name:
            self.short[name] = name
            for d in _less_one(name) if len(name) >= 4 else ():
                self._typos.setdefault(d, set()).add(name)
        if club:
            self.clubs = self.clubs | {club}
            for d in _less_one(club) if len(club) >= 5 else ():
                self._club_typos.setdefault(d, set()).add(club)
        self._known.clear()
        return self


LISTED = Lexicon(GIVEN, CLUB_WORDS)


def given_of(token: str) -> str | None:
    """As ``Lexicon.given_of``, of the listed names."""
    return LISTED.given_of(token)


def cleaned(text: str) -> str:
    """Name in lower case without the marks and brackets around all of it, and without words about scoring."""
    out = re.sub(r"\s+", " ", text.lower()).strip(_EDGES)
    while len(out) > 2 and (out[0], out[-1]) in (("[", "]"), ("(", ")")) and not re.search(r"[\[\]()]", out[1:-1].replace("(", "", 1).replace(")", "", 1) if out[0] == "[" else out[1:-1]):
        out = out[1:-1].strip(_EDGES)
    out = out.lstrip("[")
    out = out.rstrip("]") if out.endswith("]") else out
    return _SCORING.sub("", out.strip(_EDGES)).strip(_EDGES)


def _tokens(text: str) -> list[str]:
    """Folded tokens; an initial keeps its mark, which tells names apart."""
    return [fold(t) if len(t) > 1 else t for t in re.findall(r"[^\W_]+", text)]


def parse(text: str, scorer: bool, lexicon: Lexicon | None = None) -> dict | None:
    """What a typed name says: its tokens, side, given name or initial, core; None if it says nothing.

    kind is ``player``, ``club`` or ``open`` (one letter beside a core: an initial, or a club's mark).
    """
    lexicon = lexicon or LISTED
    out = cleaned(text)
    side = ""
    bracket = re.search(r"\(([^()]*)\)?\s*$", out)
    if bracket:
        if not scorer:
            side = SIDES.get(bracket[1].strip(_EDGES), "")
        if scorer or side or bracket.start() > 0:
            out = out[: bracket.start()].strip(_EDGES)
    comma = out.find(",")
    tokens = _tokens(out)
    if not tokens:
        return None
    given = [(i, lexicon.given_of(t)) for i, t in enumerate(tokens) if len(t) > 1]
    given = [(i, g) for i, g in given if g and (comma < 0 or i > 0)]
    club = [i for i, t in enumerate(tokens) if lexicon.is_club_word(t)] if not scorer else []
    marks = [i for i, t in enumerate(tokens) if i > 0 and t in SIDES and len(t) > 1] if not scorer else []
    if not scorer and (side or marks or club or len(tokens) == 1) and not (given and not (side or club or marks)):
        if not side and len(tokens) > 1 and tokens[-1] in SIDES:
            side = SIDES[tokens[-1]]
            tokens = tokens[:-1]
        rest = [t for t in tokens if len(t) > 1 and not lexicon.is_club_word(t)] or tokens
        return {"kind": "club", "side": side, "core": max(rest, key=len), "with": "", "rest": "", "tokens": tokens}
    letters = [t for t in tokens if len(t) == 1]
    if len(given) == len([t for t in tokens if len(t) > 1]) and len(given) > 1:
        given = given[1:] if comma >= 0 else given[:-1]
    named = given[0][1] if given else ""
    taken = {i for i, _ in given}
    rest = [t for i, t in enumerate(tokens) if i not in taken and len(t) > 1] or [max(tokens, key=len)]
    core = rest[0] if comma >= 0 else rest[-1] if not given else max(rest, key=len)
    if not named and len(rest) > 1:  # a given name that no list has
        named = rest[-1] if comma >= 0 else rest[0]
    others = [t for t in tokens if len(t) > 1]
    others.remove(core) if core in others else None
    first = tokens[given[0][0]] if given else named
    others.remove(first) if first in others else None
    more = " ".join(sorted(others))
    if not named and letters:
        named = f"{letters[0]}."
        trailing = len(tokens[-1]) == 1
        return {"kind": "player" if scorer else "open", "side": SIDES.get(tokens[-1], "") if trailing else "", "core": core, "with": named, "rest": more, "tokens": tokens}
    return {"kind": "player", "side": "", "core": core, "with": named or "?", "rest": more, "tokens": tokens}


def _shortens(short: str, long: str) -> bool:
    """Whether a word of three letters or more is a longer one's short form: its first letter, then letters of it in order."""
    rest = iter(long[1:])
    return len(short) >= 3 and short[0] == long[0] and all(c in rest for c in short[1:])


def token_cost(a: str, b: str, lexicon: Lexicon | None = None, shorts: bool = True) -> float:
    """0 for alike, up to 1 for unlike tokens: initials, short forms and single edits cost little."""
    if a == b:
        return 0.0
    known = (lexicon or LISTED).short
    short, long = sorted((a.rstrip("."), b.rstrip(".")), key=len)
    if len(short) == 1 and long.startswith(fold(short)):
        own = MARKED_INITIALS.get(long, long[0])
        return 0.1 if short == own else 0.2 if short == fold(short) else 1.0
    if known.get(short) == long or known.get(long) == short or (short in known and known.get(short) == known.get(long)):
        return 0.05
    if len(short) >= 2 and long.startswith(short) and (a.endswith(".") or b.endswith(".")):
        return 0.1
    if len(short) >= 4 and osa(short, long, 1) <= 1:
        return 0.3
    # A short form that no list has; of words that the lists have it would be another name.
    return SHORT_FORM if shorts and short not in known and long not in known and _shortens(short, long) else 1.0


def alignment(a: list[str], b: list[str], lexicon: Lexicon | None = None, shorts: bool = True) -> float:
    """Least mean cost of assigning each token of the shorter name to another one of the longer. shorts: whether a token may be a
    short form that no list has."""
    few, many = sorted((a, b), key=len)
    if not few:
        return 1.0
    costs = [[token_cost(x, y, lexicon, shorts) for y in many] for x in few]
    if len(few) == 1:
        return min(costs[0])
    # Shortest augmenting paths with potentials; row and column 0 stand for none.
    rows, cols = len(few), len(many)
    u, v, owner = [0.0] * (rows + 1), [0.0] * (cols + 1), [0] * (cols + 1)
    for row in range(1, rows + 1):
        owner[0], at = row, 0
        least, way, done = [float("inf")] * (cols + 1), [0] * (cols + 1), [False] * (cols + 1)
        while owner[at]:
            done[at] = True
            i = owner[at]
            for j in range(1, cols + 1):
                if not done[j] and (now := costs[i - 1][j - 1] - u[i] - v[j]) < least[j]:
                    least[j], way[j] = now, at
            to = min((j for j in range(1, cols + 1) if not done[j]), key=least.__getitem__)
            delta = least[to]
            for j in range(cols + 1):
                if done[j]:
                    u[owner[j]] += delta
                    v[j] -= delta
                else:
                    least[j] -= delta
            at = to
        while at:
            owner[at], at = owner[way[at]], way[at]
    return sum(costs[owner[j] - 1][j - 1] for j in range(1, cols + 1) if owner[j]) / rows


def evidence(names: list[str], scorer: bool) -> list[tuple[str, str, str, str]]:
    """(kind, word, other, core) that two spellings of one record show of their words: see ``Lexicon.with_learned``. The core is
    the longest word that both have, but for one edit."""
    if scorer or len(names) != 2 or not all(names):
        return []
    a, b = (_tokens(re.sub(r"\([^()]*\)?\s*$", "", cleaned(n))) for n in names)
    core = ""
    for x in sorted(a, key=len, reverse=True):
        met = next((y for y in b if x == y or (len(x) >= 4 and len(y) >= 4 and osa(x, y, 1) <= 1)), None)
        if met is not None and len(x) > 1:
            a.remove(x)
            b.remove(met)
            core = core or x
    if not core:
        return []
    out, words = [], ([t for t in a if len(t) > 1 and t not in SIDES], [t for t in b if len(t) > 1 and t not in SIDES])
    for own, others, letters in ((words[0], words[1], [t for t in b if len(t) == 1]), (words[1], words[0], [t for t in a if len(t) == 1])):
        for t in own:
            if any(fold(c) == t[0] for c in letters):
                out.append(("given", t, "", core))
            elif not others and not letters:
                out.append(("dropped", t, "", core))
    if len(words[0]) == len(words[1]) == 1 and len(a) == len(b) == 1:
        out.append(("alias", *sorted((words[0][0], words[1][0])), core))
    return out


def learned_lexicon(records: DataFrame, listed: Lexicon) -> Lexicon:
    """The listed lexicon with the words that the records' own paired spellings show to be given names, short forms of them, or
    words of clubs. Words met with less than ``LEARNED_SHARE`` of all cores are left out, so few words come to the driver."""

    def shown(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            yield pd.DataFrame([e for n, s in zip(frame["names"], frame["scorer"], strict=True) for e in evidence(list(n), s)], columns=["kind", "word", "other", "core"])

    seen = records.where(F.size("names") == 2).select("names", "scorer").mapInPandas(shown, "kind string, word string, other string, core string").distinct()
    counts = materialize(seen.groupBy("kind", "word", "other").agg(F.count("*").alias("cores")))
    total = counts.agg(F.sum("cores")).first()[0] or 0
    kept = counts.where(F.col("cores") >= max(LEARNED_CORES, LEARNED_SHARE * total)).collect()
    return listed.with_learned(sorted(tuple(r) for r in kept))


def _forms(records: DataFrame, lexicon: Lexicon) -> DataFrame:
    """(record, run, kind, side, core, with, rest) of each name of each record (record, run, names, scorer)."""

    def parsed(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            out = []
            for record, run, names, scorer in zip(frame["record"], frame["run"], frame["names"], frame["scorer"], strict=True):
                found = [p for p in (parse(n, scorer, lexicon) for n in names if n) if p]
                out += [(record, run, p["kind"], p["side"], p["core"], p["with"], p["rest"]) for p in _agreed(found)]
            yield pd.DataFrame(out, columns=["record", "run", "kind", "side", "core", "with", "rest"])

    return records.mapInPandas(parsed, "record bigint, run string, kind string, side string, core string, with string, rest string")


def _agreed(found: list[dict]) -> list[dict]:
    """The names of one record, each completed by the other."""
    kinds = {p["kind"] for p in found}
    if "club" in kinds:
        side = next((p["side"] for p in found if p["kind"] == "club" and p["side"]), "")
        return [p | {"kind": "club", "side": side, "with": "", "rest": ""} for p in found]
    full = next((p["with"] for p in found if p["kind"] == "player" and not p["with"].endswith(".") and p["with"] != "?"), None)
    if full:
        swapped = lambda p: p["core"] == full and p["with"] not in ("?", full) and not p["with"].endswith(".")
        return [p | {"kind": "player", "with": full, "side": "", "core": p["with"] if swapped(p) else p["core"]} for p in found]
    return found


def _held(df: DataFrame, count: int) -> DataFrame:
    return F.broadcast(df) if count <= BROADCAST_ROWS else df


def link_names(records: DataFrame) -> DataFrame:
    """(record, name_class) of each record (record, run, names, scorer): the class of the name it carries.

    names: the spellings that one record has of its one name; scorer: whether they are players by where they
    stand. Records with the same class name the same player or club; records without a readable name have
    none. Nulls and empty names say nothing; names of any length are read. A lone initial that fits several given names
    stays apart from all of them. The class is a hash of its best-attested spelling.
    """
    lexicon = learned_lexicon(records, LISTED)
    forms = materialize(_forms(records, lexicon))
    # One letter beside a core is a club's mark where clubs have that core or, if nobody has it, one near to it.
    cores = forms.groupBy("core").agg(F.bool_or(F.col("kind") == "club").alias("of_club"), F.bool_and(F.col("kind") == "open").alias("unknown"))
    cores = materialize(cores.withColumn("block", F.lit("club")))
    stray = near_pairs(cores.where("unknown").select("block", F.col("core").alias("word")), cores.where("of_club").select("block", F.col("core").alias("word")), "word", "block", two_from=NO_TWO)
    clubs = materialize(cores.where("of_club").select("core").unionByName(stray.select(F.col("a").alias("core"))).distinct().withColumn("of_club", F.lit(True)))
    forms = forms.join(_held(clubs, clubs.count()), "core", "left")
    is_club = (F.col("kind") == "club") | ((F.col("kind") == "open") & F.coalesce("of_club", F.lit(False)))
    forms = forms.withColumns({"block": F.when(is_club, F.concat(F.lit("club:"), "side")).otherwise(F.concat(F.lit("player:"), folded(F.substring("with", 1, 1)))), "with": F.when(is_club, "").otherwise(F.col("with")), "rest": F.when(is_club, "").otherwise(F.col("rest"))})
    forms = forms.withColumn("node", F.xxhash64("block", "with", "core", "rest")).select("record", "run", "node", "block", "with", "core", "rest")
    forms = materialize(forms)
    nodes = materialize(forms.groupBy("node", "block", "with", "core", "rest").agg(F.count_distinct("run").alias("support")))
    size = nodes.count()
    alike, parents = _parents(nodes, size, forms, lexicon)
    roots = _followed(nodes.select("node", F.col("support").alias("told")), size, parents)
    # A class joins another one by any spellings that are alike and hardly less attested than itself, until nothing moves.
    both = alike.unionByName(alike.select(F.col("b_node").alias("a_node"), F.col("a_node").alias("b_node"))).distinct()
    for s in "ab":
        both = both.join(_held(nodes.select(F.col("node").alias(f"{s}_node"), F.col("support").alias(f"{s}_support")), size), f"{s}_node")
    both = materialize(both.select("a_node", "b_node", F.least("a_support", "b_support").alias("bridge")))
    while True:
        a, b = (_held(roots.select(F.col("node").alias(f"{s}_node"), F.col("root").alias(f"{s}_root"), F.col("told").alias(f"{s}_told")), size) for s in "ab")
        met = both.join(a, "a_node").join(b, "b_node")
        better = (F.col("b_told") > F.col("a_told")) | ((F.col("b_told") == F.col("a_told")) & (F.col("b_root") < F.col("a_root")))
        joins = met.where((F.col("a_root") != F.col("b_root")) & (F.col("a_told") <= PEAK * F.col("bridge")) & better)
        joins = materialize(joins.groupBy("a_root").agg(F.max_by(F.struct(F.col("b_root").alias("root"), F.col("b_told").alias("told")), F.struct("b_told", -F.col("b_root"))).alias("to")).select(F.col("a_root").alias("node"), F.col("to.root").alias("parent")))
        if joins.isEmpty():
            break
        tops = _followed(roots.where("node = root").select("node", "told"), size, joins).select(F.col("node").alias("root"), F.col("root").alias("top"), F.col("told").alias("top_told"))
        roots = materialize(roots.join(_held(tops, size), "root").select("node", F.col("top").alias("root"), F.col("top_told").alias("told")))
    weighed = forms.select("record", "node").join(_held(nodes.select("node", "support").join(_held(roots, size), "node"), size), "node")
    return weighed.groupBy("record").agg(F.max_by("root", F.struct("support", "root")).alias("name_class"))


def _followed(nodes: DataFrame, size: int, parents: DataFrame) -> DataFrame:
    """(node, root, told) of nodes (node, told): where the pointers of each node end, and what is told of that end. Pointers
    never form a circle, as each goes to a better-attested node; they are doubled until none moves."""
    known = nodes.select(F.col("node").alias("root"), "told")
    roots = materialize(nodes.select("node").join(_held(parents, size), "node", "left").select("node", F.coalesce("parent", "node").alias("root")))
    while True:
        up = roots.select(F.col("node").alias("root"), F.col("root").alias("next"))
        moved = materialize(roots.join(_held(up, size), "root").select("node", F.col("next").alias("root"), (F.col("next") != F.col("root")).alias("moved")))
        roots = moved.select("node", "root")
        if moved.where("moved").isEmpty():
            return materialize(roots.join(_held(known, size), "root").select("node", "root", "told"))


def _parents(nodes: DataFrame, size: int, forms: DataFrame, lexicon: Lexicon) -> tuple[DataFrame, DataFrame]:
    """(a_node, b_node) of the spellings that may be one name; (node, parent) of those that another one explains."""
    # A name is met by its core and by each further token; one whose given name no list has also by that, as it may be either.
    listed = lambda c: F.col(c).isin(list(lexicon.given))
    block_of = lambda c: F.concat(F.lit("player:"), folded(F.substring(c, 1, 1)))
    own = ["node", "rest", "support", F.concat_ws(" ", "core", "with", "rest").alias("name")]
    free = F.col("block").startswith("player:") & ~F.col("with").endswith(".") & (F.col("with") != "?") & ~listed("with")
    views = nodes.select(*own, F.lit(False).alias("swapped"), "block", "with", "core", F.explode(F.filter(F.concat(F.array("core"), F.split("rest", " ")), lambda t: t != "")).alias("word"))
    views = materialize(views.unionByName(nodes.where(free).select(*own, F.lit(True).alias("swapped"), block_of("core").alias("block"), F.col("core").alias("with"), F.col("with").alias("core"), F.col("with").alias("word"))).distinct())
    words = views.select("block", "word").distinct()
    near = near_pairs(words, words, "word", "block", two_from=NO_TWO)
    sides = lambda name: views.select("block", *[F.col(c).alias(f"{name}_{c}") for c in ("node", "with", "core", "rest", "name", "support", "swapped", "word")])
    met = near.select("block", F.col("a").alias("a_word"), F.col("b").alias("b_word")).join(sides("a"), ["block", "a_word"]).join(sides("b"), ["block", "b_word"])
    met = met.where("a_node <> b_node").drop("a_word", "b_word").distinct()

    def aligned(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            rows = list(zip(frame["a_with"], frame["a_core"], frame["a_rest"], frame["b_with"], frame["b_core"], frame["b_rest"], strict=True))
            both = [([x for x in (aw, ac, *ar.split()) if x], [x for x in (bw, bc, *br.split()) if x]) for aw, ac, ar, bw, bc, br in rows]
            # People shorten given names: a short form counts only beside the same family name, and not if both are read backwards.
            same = [not (a and b) and (ac == bc or (len(ac) >= 4 and len(bc) >= 4 and osa(ac, bc, 1) <= 1)) for (_, ac, _, _, bc, _), a, b in zip(rows, frame["a_swapped"], frame["b_swapped"], strict=True)]
            frame["cost"] = [alignment(x, y, lexicon, s) for (x, y), s in zip(both, same, strict=True)]
            # All tokens of the shorter name together: less than one unlike token.
            yield frame[[c * min(len(x), len(y)) <= MOST_COST for c, (x, y) in zip(frame["cost"], both, strict=True)]]

    schema = ", ".join(f"{s}_{c}" for s in "ab" for c in ("node bigint", "with string", "core string", "rest string", "name string", "support bigint", "swapped boolean")) + ", cost double"
    fits = materialize(met.select(*[c.split()[0] for c in schema.split(", ")[:-1]]).mapInPandas(aligned, schema))
    initial = lambda c: F.col(c).endswith(".")
    stronger = (F.col("b_support") > F.col("a_support")) | ((F.col("b_support") == F.col("a_support")) & (F.col("b_name") < F.col("a_name")))
    # Spellings of the same given name or side, and initials of the same letter; of other given names those that the
    # alignment lets pass, unless the list knows both: then they are two names (Michal, Michael).
    given = (F.col("a_with") == F.col("b_with")) | ~(initial("a_with") | initial("b_with") | (listed("a_with") & listed("b_with")))
    alike = fits.where(given & stronger)
    best = lambda df, rank: df.groupBy("a_node").agg(F.max_by("b_node", F.struct("b_support", "b_name")).alias("parent"), F.lit(rank).alias("rank"))
    # Initials to the one given name that they fit best: by the same core, else by a near one.
    full = fits.where(initial("a_with") & ~initial("b_with"))
    meant = full
    full = full.withColumn("least", F.min("cost").over(Window.partitionBy("a_node"))).where(F.col("cost") <= F.col("least"))
    # Spellings of one given name that end in one spelling are one name.
    ends = _followed(nodes.select("node", F.col("support").alias("told")), size, best(alike, 1).select(F.col("a_node").alias("node"), "parent")).select(F.col("node").alias("b_node"), F.col("root").alias("b_root"))
    full = full.join(_held(ends, size), "b_node")
    one = full.groupBy("a_node").agg(F.count_distinct("b_with").alias("names"), F.count_distinct("b_root").alias("roots"), F.min("b_with").alias("b_with"), F.max_by("b_node", F.struct("b_support", "b_name")).alias("parent"), F.lit(2).alias("rank"))
    one = one.where("names = 1 or roots = 1").drop("roots")
    # The two spellings of one record.
    carried = forms.select("record", "node").distinct()
    row = carried.alias("x").join(carried.alias("y"), "record").where("x.node <> y.node").select(F.col("x.node").alias("a_node"), F.col("y.node").alias("b_node")).distinct()
    a, b = (_held(nodes.select(*own, "with").select(*[F.col(c).alias(f"{s}_{c}") for c in ("node", "with", "name", "support")]), size) for s in "ab")
    row = row.join(a, "a_node").join(b, "b_node").where((F.col("a_with") == F.col("b_with")) & stronger)
    one = materialize(one.drop("names"))
    meant = meant.join(one.select("a_node", "b_with"), ["a_node", "b_with"], "left_semi")
    pairs = fits.where(given).unionByName(meant).select("a_node", "b_node").unionByName(row.select("a_node", "b_node"))
    ways = best(row, 3).unionByName(one.drop("b_with")).unionByName(best(alike, 1))
    return pairs, ways.groupBy("a_node").agg(F.max_by("parent", "rank").alias("parent")).withColumnRenamed("a_node", "node")


def linked_pairs(classes: DataFrame) -> DataFrame:
    """(record_a, record_b), record_a < record_b: all pairs of records of one class (record, name_class).

    A class that is too large for one piece is cut on one side, and the other side is dealt to each cut, so that
    no task pairs more than a piece with the class.
    """
    sizes = classes.groupBy("name_class").agg(F.count("*").alias("n")).where("n > 1").withColumn("cuts", F.ceil(F.col("n") / PIECE).cast("int"))
    members = classes.join(sizes.select("name_class", "cuts"), "name_class")
    left = members.select("name_class", F.pmod(F.xxhash64("record"), "cuts").cast("int").alias("cut"), F.col("record").alias("record_a"))
    right = members.select("name_class", F.explode(F.sequence(F.lit(0), F.col("cuts") - 1)).alias("cut"), F.col("record").alias("record_b"))
    return left.join(right, ["name_class", "cut"]).where("record_a < record_b").select("record_a", "record_b")
