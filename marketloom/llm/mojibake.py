"""Texts that were decoded with the wrong character encoding, restored by best-first search.

A state is a text; a step encodes it with one code page and decodes the bytes with another, or unescapes it.
The cost of a text is how implausible its characters are where they stand, given the languages that the corpus is written
in, as all of its documents tell; a text that is wholly of another known language is plausible too. The search always
goes on from the cheapest text reached and never visits one twice. The whole text is tried first; what that leaves
implausible is searched sentence by sentence, and at last run by run. Plausible texts are told by one
expression inside the JVM and never reach Python.
"""

from __future__ import annotations

import hashlib
import heapq
import html
import re
from collections.abc import Iterator
from functools import lru_cache

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# The letters that each language writes beside ASCII.
ALPHABETS = {
    "pl": "ąćęłńóśźż", "de": "äöüß", "es": "áéíóúñü", "cs": "áčďéěíňóřšťúůýž", "sk": "áäčďéíĺľňóôŕšťúýž", "hu": "áéíóöőúüű", "fr": "àâçèéêëîïôùûü", "it": "àèéìòù", "pt": "áâãàçéêíóôõú",
    "ro": "ăâîșț", "sv": "åäö", "da": "åæø", "tr": "çğıöşüİ", "hr": "čćđšž", "lt": "ąčęėįšųūž", "ru": "абвгдежзийклмнопрстуфхцчшщъыьэюяё", "uk": "абвгґдеєжзиіїйклмнопрстуфхцчшщьюя", "el": "αβγδεζηθικλμνξοπρστυφχψωςάέήίόύώ",
}
MARKS = "¡–—„”“’‘…€«»"
#: Languages that count as the corpus's own where no corpus was looked at; least share of the documents that makes a
#: language one of the corpus's own.
HOME, HOME_SHARE = ("pl", "de", "es"), 0.01
#: Letters of one foreign language that a text must hold, different ones, to be taken as written in it; what such a text costs:
#: less than a step, so that none is taken from it.
COHERENT, FOREIGN = 3, 0.2
#: Fewest documents that make a language one of the corpus's own.
LEAST_DOCS = 10
_RARE = set("âêîôûàèùçëïãõøÂÊÎÔÛÀÈÙÇËÏÃÕØ")
_VOWELS = "aeiouáéíóúAEIOUÁÉÍÓÚ"
_LONE = set("£¥¤¢§±¶¼½¾®©°¯¸¨¬µ·¦²³¹ªº«»")
#: Code pages a text may have been read with, and those that its bytes may have been in.
READ_WITH = ("cp1252", "latin-1", "cp1250", "iso8859-2", "cp852", "cp437", "cp850", "mac-roman", "mac-latin2", "iso8859-15", "cp1251")
WRITTEN_IN = ("cp1250", "iso8859-2", "cp1252", "cp852", "mac-latin2")
#: Pages between which bytes are often taken for one another; a step between others has a further price.
OFTEN_READ, OFTEN_WRITTEN = ("cp1252", "latin-1", "cp1250", "iso8859-2", "iso8859-15"), ("cp1250", "iso8859-2", "cp1252")
#: Price of a step, further price of a rare one, most steps, and most texts expanded for one search.
STEP, RARE_STEP, MOST_STEPS, MOST_TEXTS = 0.4, 1.6, 4, 400
#: Most that a restored text may cost, as a share of what it cost before.
LEFT = 0.3
#: A text that costs as much for a character after restoration has lost it.
LOST = 3.0
_ESCAPED = re.compile(r"&(?:#\d{2,7}|#[xX][0-9a-fA-F]{2,6}|[A-Za-z][A-Za-z0-9]{1,31});|\\u[0-9a-fA-F]{4}")


class Profile:
    """The languages that a corpus is written in: their letters are plausible wherever they stand in a word."""

    def __init__(self, home: tuple[str, ...] = HOME):
        cased = lambda letters: letters + "".join(c.upper() for c in letters if len(c.upper()) == 1 and c.upper() != c)
        self.home = home
        self.alphabets = tuple(set(cased(ALPHABETS[h])) | set("¿¡" if h == "es" else "") for h in home)
        self.foreign = tuple(set(cased(letters)) for name, letters in ALPHABETS.items() if name not in home)
        # Å stands for UTF-8 read with another page so often that it is judged by its place, whatever the language.
        self.letters = "".join(sorted(set().union(*(set(cased(ALPHABETS[h])) for h in home)) - {"Å"})) + "å"
        self.upper, self.lower = "".join(c for c in self.letters if c.isupper()), "".join(c for c in self.letters if c.islower())
        # A place may only be doubtful where a character is not plain ASCII, or where an escape stands; so the other
        # alternatives are tried nowhere else.
        self.doubtful = (
            r"&(?:#\d{2,7}|#[xX][0-9a-fA-F]{2,6}|[A-Za-z][A-Za-z0-9]{1,31});|\\u[0-9a-fA-F]{4}|(?=[^\x09\x0a\x0d\x20-\x7e])(?:"
            rf"[^\x09\x0a\x0d\x20-\x7e\u00a0{self.letters.replace('Å', '')}{MARKS}¿\x{{1F300}}-\x{{1FAFF}}\u2600-\u27bf\ufe0f]"
            r"|(?iu:ń[aeiouáéíóú])|(?<!\p{L})[żĄ]\p{Lu}|Ä[^\p{L}\s]|¿\p{Ll}|(?<=\p{L})¿|[„”“’‘…€«»]\p{L}?[„”“’‘…€«»]|(?<=\p{L})[„…€‘]\p{L}|[ĂĹ])"
        )

    def language(self, text: str) -> set[str] | None:
        """The letters of a foreign language that all letters of a text beside ASCII are of; None if there is none such, or
        if the text holds too few of them to tell. Words that mix scripts are of none."""
        high = set(_HIGH.findall(text))
        if len({c.lower() for c in high}) < COHERENT or any(high <= a for a in self.alphabets) or _MIXED_SCRIPTS.search(text):
            return None
        return next((a for a in self.foreign if high <= a), None)


_HIGH = re.compile(r"[^\W\d_\x00-\x7f]")
_MIXED_SCRIPTS = re.compile(r"[A-Za-z\u00c0-\u024f][\u0370-\u04ff]|[\u0370-\u04ff][A-Za-z\u00c0-\u024f]")
DEFAULT = Profile()


def profile_of(docs: DataFrame, text: str) -> Profile:
    """The languages of a corpus, counted over all of its documents: those that at least ``HOME_SHARE`` of the documents that
    tell a language (and ``LEAST_DOCS``) are wholly written in. A document tells the one language whose alphabet holds all of
    its letters beside ASCII, where these are ``COHERENT`` different ones or more. Without such a language the default.

    Garbled documents hold letters of no one language, or signs inside words, and do not count. All of it is one expression
    inside the JVM, and only a count for each language reaches the driver.
    """
    sound = docs.where(F.col(text).rlike(r"[^\x00-\x7f]") & ~F.col(text).rlike(_FAULTY))
    # The arrays of generators are barriers: letters are found once, not for each language.
    high = sound.select(F.explode(F.array(F.array_distinct(F.split(F.regexp_replace(text, _NO_HIGH, ""), "")))).alias("high"))
    high = high.where(F.size("high") >= COHERENT).select(F.explode(F.array(F.array_join("high", ""))).alias("high"))
    alphabets = {name: "".join(sorted(set(letters + letters.upper()))) for name, letters in ALPHABETS.items()}
    fits = F.array_compact(F.array(*(F.when(F.col("high").rlike(f"^[{letters}]*$"), name) for name, letters in alphabets.items())))
    told = high.select(F.explode(F.array(fits)).alias("fits")).where(F.size("fits") == 1).select(F.get("fits", F.lit(0)).alias("lang"))
    counts = {r["lang"]: r["count"] for r in told.groupBy("lang").count().collect()}
    total = sum(counts.values())
    home = tuple(name for name in ALPHABETS if counts.get(name, 0) >= max(LEAST_DOCS, HOME_SHARE * total))
    return Profile(home) if home else DEFAULT


#: A sign inside a word, looked at only where a sign is; what is no letter (or letter-like number) beside ASCII.
_FAULTY = r"(?=[^\p{L}\p{N}_\s\x1c-\x1f\x85\p{Z}\x21-\x7e’–—])(?<=\p{L})(?s:.)\p{L}"
_NO_HIGH = r"[\x00-\x7f]+|[^\p{L}\p{No}\p{Nl}]+"


@lru_cache(maxsize=32)
def _tables(name: str) -> tuple[dict[int, str], dict[str, int]]:
    """A code page, its undefined bytes read as control characters, as most software does."""
    out = {}
    for i in range(256):
        try:
            out[i] = bytes([i]).decode(name)
        except UnicodeDecodeError:
            out[i] = chr(i)
    back = {}
    for i, c in out.items():
        back.setdefault(c, i)
    return out, back


@lru_cache(maxsize=32)
def _to_bytes(name: str) -> dict[int, int]:
    """Translation of a text to the characters of its bytes' numbers, for texts that the code page holds."""
    return {ord(c): i for c, i in _tables(name)[1].items()}


@lru_cache(maxsize=32)
def _holds(name: str) -> re.Pattern:
    return re.compile("[" + "".join(map(re.escape, _tables(name)[1])) + "]*")


def _encode(text: str, name: str) -> bytes | None:
    if not _holds(name).fullmatch(text):
        return None
    return text.translate(_to_bytes(name)).encode("latin-1")


def _decode(data: bytes, name: str) -> str | None:
    if name == "utf-8":
        try:
            return data.decode("utf-8")
        except UnicodeDecodeError:
            return None
    table = _tables(name)[0]
    return data.decode("latin-1").translate(table)


def cost(text: str, profile: Profile = DEFAULT) -> float:
    """How implausible the characters of a text are where they stand; 0 for plain text of the corpus's languages."""
    foreign = profile.language(text)
    total = FOREIGN if foreign else 0.0
    for m in re.finditer(r"[^\x09\x0a\x0d\x20-\x7e]", text):
        i, c = m.start(), m[0]
        before, after = text[i - 1 : i], text[i + 1 : i + 2]
        near = before.isalpha() or after.isalpha()
        if c == "\ufffd":
            total += 10
        elif "\x80" <= c <= "\x9f" or c < " " or c == "\xad":
            total += 5
        elif foreign and c in foreign:
            total += 2 if c.isupper() and before.islower() else 0
        elif c in "ÄÅ":
            total += 0 if after.isalpha() and after < "\u0250" or not after.strip() and not before.isalpha() else 1 if not near else 3
        elif c in profile.letters:
            # A capital inside a word; a Spanish ñ (Polish writes ni before a vowel); ¿ and ¡ before a sentence.
            total += 2 if c.isupper() and before.islower() or c in "ńŃ" and after and after in _VOWELS or c in "żĄ" and not before.isalpha() and after.isupper() else 0
        elif c == "¿":
            total += 0 if not before.isalpha() and (after.isupper() or not after.strip()) else 3
        elif c in MARKS:
            total += 2 if before.isalpha() and after.isalpha() and c not in "’–—" else 0.2 if before > "\x7f" and not before.isalnum() and after > "\x7f" else 0
        elif c in _RARE:
            total += 1 if not after.strip() or after.isalpha() else 3
        elif c in "¹²³":
            total += 3 if after.isalpha() else 0.5 if before.isalpha() else 0
        elif c in _LONE:
            total += 3 if near else 0
        elif c == "\xa0":
            total += 0 if not near else 0.1
        elif c in "æœŒŸ":
            total += 2 if near else 1
        elif "\u2500" <= c <= "\u259f" or "\u0370" <= c <= "\u04ff" or "\u2200" <= c <= "\u22ff" or c in "⌐⌡⌠ƒˇ˘˛˝ˆ˜†‡•‰™‹›‚ﬁﬂ◊Ω":
            total += 3
        elif c.isalpha():
            total += 2 if c < "\u0250" else 1
        elif c < "\u2000":
            total += 1
    return total


_CYRILLIC = re.compile(r"(?<![^\W\d_])[\u0400-\u04ff]{2,}(?![^\W\d_])")
_POLISH = set(ALPHABETS["pl"] + ALPHABETS["pl"].upper())


def _mixed(text: str, profile: Profile) -> int:
    """Letters of a text that are not of its main language, or of another case than the letters around them."""
    high = re.findall(r"[^\x00-\x7f]", text)
    letters = [c for c in high if any(c in a for a in profile.alphabets)]
    other_case = len(re.findall(rf"(?<=[a-z])[{profile.upper}]|(?<=[A-Z])[{profile.lower}](?=[A-Z])", text))
    return len(letters) - max(sum(c in a for c in letters) for a in profile.alphabets) + other_case


def _steps(text: str) -> Iterator[tuple[str, bool, float]]:
    """Texts one step away; whether the step is a decoding; its price. UTF-8 comes first: it is seldom met by chance."""
    bytes_of = {read: data for read in READ_WITH if (data := _encode(text, read)) is not None}
    for data in bytes_of.values():
        if (decoded := _decode(data, "utf-8")) is not None:
            yield decoded, True, STEP
    if "&" in text and (plain := html.unescape(text)) != text:
        yield plain, False, STEP
    if "\\u" in text:
        yield re.sub(r"\\u([0-9a-fA-F]{4})", lambda m: chr(int(m[1], 16)), text), False, STEP
    for read, data in bytes_of.items():
        for written in WRITTEN_IN:
            # A whole Cyrillic word is one, unless it is made of Polish letters alone.
            if read == "cp1251" and any(not _POLISH.issuperset(_decode(_encode(w, read), written)) for w in _CYRILLIC.findall(text)):
                continue
            if written != read:
                often = read in ("cp1252", "latin-1", "cp852", "cp437") or (read in OFTEN_READ and written in OFTEN_WRITTEN)
                yield _decode(data, written), True, STEP if often else STEP + RARE_STEP


def _unescaped(text: str) -> str:
    return re.sub(r"\\u([0-9a-fA-F]{4})", lambda m: chr(int(m[1], 16)), html.unescape(text))


def search(text: str, profile: Profile = DEFAULT) -> str:
    """The cheapest text that steps reach, the text itself where none is cheaper; of equally cheap ones, that of
    one language. At least one step on the way must be a decoding: texts that only hold escapes are not garbled."""
    first = cost(text, profile)
    if _ESCAPED.search(text):  # what is escaped may be garbled: the text counts as what it says
        first = max(first, cost(_unescaped(text), profile))
    if first == 0:
        return text
    best, best_total, best_mixed = text, first, 0
    queue, seen, count, expanded = [(first, 0, 0, 0.0, text, False)], {hashlib.md5(text.encode("utf-8", "surrogatepass")).digest()}, 1, 0
    while queue and expanded < MOST_TEXTS:
        _, _, depth, paid, now, decoded = heapq.heappop(queue)
        # One more step costs as much at least; what would cost more than the best text is not looked at.
        if depth == MOST_STEPS or paid + STEP > best_total:
            continue
        expanded += 1
        for then, is_decoding, price in _steps(now):
            if paid + price > best_total or (paid + price == best_total and best_mixed == 0):
                continue
            key = hashlib.md5(then.encode("utf-8", "surrogatepass")).digest()
            if key in seen:
                continue
            count += 1
            total = (left := cost(then, profile)) + paid + price
            if price == STEP:  # a dearer way must not close a cheaper one
                seen.add(key)
            if total <= best_total and left <= LEFT * first and (decoded or is_decoding):
                mixed = _mixed(then, profile)
                if total < best_total or mixed < best_mixed:
                    best, best_total, best_mixed = then, total, mixed
            # From a text that got much worse nothing plain is reached.
            if total <= first + 2 * STEP:
                heapq.heappush(queue, (total, count, depth + 1, paid + price, then, decoded or is_decoding))
    return best


def _runs(text: str, profile: Profile) -> str:
    """Each run of non-ASCII characters searched by itself, from the last one on; a run is only changed where that makes the
    text around it more plausible."""
    for m in reversed(list(re.finditer(r"[^\x00-\x7f]+", text))):
        found = search(m[0], profile)
        before, after = text[max(0, m.start() - 3) : m.start()], text[m.end() : m.end() + 3]
        if found != m[0] and cost(before + found + after, profile) <= LEFT * cost(before + m[0] + after, profile):
            text = text[: m.start()] + found + text[m.end() :]
    return text


_PARTS = re.compile(r"((?<=[.!?])[ \t]+|[\r\n]+)")


def _by_parts(text: str, profile: Profile) -> str:
    """Each sentence searched by itself, and the runs of those that stay implausible."""
    text = "".join(p if i % 2 else search(p, profile) for i, p in enumerate(_PARTS.split(text)))
    return "".join(p if i % 2 or cost(p, profile) < LOST else _runs(p, profile) for i, p in enumerate(_PARTS.split(text)))


def restore(text: str, profile: Profile = DEFAULT) -> str | None:
    """The restored text; the text itself where it is not garbled; None where characters are lost for good."""
    if "\ufffd" in text:
        return None
    whole = search(text, profile)
    if cost(whole, profile) > 0:
        # A text of which only parts are garbled is no better for a step that suits all of it half.
        whole = min((*(_by_parts(t, profile) for t in dict.fromkeys((whole, text))), whole), key=lambda t: cost(t, profile))
    return whole


def restored_texts(docs: DataFrame, doc_id: str, text: str, profile: Profile | None = None) -> DataFrame:
    """(doc_id, restored) of each garbled text; restored is null where characters are lost for good.

    Null, empty and plausible texts give no row. A text is garbled if some decoding step makes it more
    plausible, or if it holds the replacement character. Repeated rows give repeated rows. What is plausible depends on the
    languages of the corpus, which all of its documents tell (``profile_of``).
    """
    rows = docs.select(F.col(doc_id).alias("doc"), F.col(text).alias("body"))
    profile = profile or profile_of(rows, "body")

    def repaired(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            out = [(i, t, restore(t, profile)) for i, t in zip(frame["doc"], frame["body"], strict=True)]
            yield pd.DataFrame([(i, r) for i, t, r in out if r != t], columns=["doc", "restored"])

    found = rows.where(F.col("body").rlike(profile.doubtful)).mapInPandas(repaired, f"doc {dict(rows.dtypes)['doc']}, restored string")
    return found.select(F.col("doc").alias(doc_id), "restored")
