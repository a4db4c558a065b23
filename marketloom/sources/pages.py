"""Saved HTML pages to rows: one for each element that shows a price, with its place and headings."""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from html.parser import HTMLParser

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from marketloom.functions.text import only_value
from marketloom.operators.nested import Members, read_json

_VOID = frozenset("area base br col embed hr img input link meta source track wbr".split())
_PRICE = re.compile(r"(?<![\d.,])([1-9]\d{0,2}[.,]\d{2})(?![\d.,])")
ROWS = "{key} {kind}, at int, dom_path string, heading string, label string, odds string, visible boolean"


class _Page(HTMLParser):
    """Collects buttons, the nearest heading before each, and the path of open elements."""

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.open: list[list] = []
        self.children: list[dict[str, int]] = [{}]
        self.heading = ""
        self.rows: list[tuple] = []

    def handle_starttag(self, tag: str, attrs: list) -> None:
        count = self.children[-1].get(tag, 0)
        self.children[-1][tag] = count + 1
        if tag in _VOID:
            return
        given = dict(attrs)
        hidden = "hidden" in given or given.get("aria-hidden") == "true" or "display:none" in (given.get("style") or "").replace(" ", "")
        hidden = hidden or bool(self.open and self.open[-1][3])
        self.open.append([tag, count, [], hidden])
        self.children.append({})

    def handle_data(self, data: str) -> None:
        for element in self.open:
            element[2].append(data)

    def handle_endtag(self, tag: str) -> None:
        if not any(e[0] == tag for e in self.open):
            return
        while self.open:
            name, count, text, hidden = self.open.pop()
            self.children.pop()
            said = " ".join("".join(text).split())
            if re.fullmatch(r"h[1-6]", name):
                self.heading = said
            elif name == "button" and (price := _PRICE.search(said)):
                path = ">".join(f"{n}[{c}]" for n, c, _, _ in self.open) + f">{name}[{count}]"
                label = " ".join((said[: price.start()] + said[price.end() :]).split())
                self.rows.append((path, self.heading, label, price[1].replace(",", "."), not hidden))
            if name == tag:
                return


def priced_buttons(page: str | None) -> list[tuple]:
    """(path, heading, label, odds, visible) of each button with a price, in the order of the page."""
    parser = _Page()
    parser.feed(page or "")
    parser.close()
    return parser.rows


def dom_rows(pages: DataFrame, key: str, html: str) -> DataFrame:
    """(key, at, dom_path, heading, label, odds, visible) of every button with a price. Null and empty pages give none."""

    def parsed(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            rows = [(k, i, *row) for k, page in zip(frame[key], frame[html], strict=True) for i, row in enumerate(priced_buttons(page))]
            yield pd.DataFrame(rows, columns=[key, "at", "dom_path", "heading", "label", "odds", "visible"])

    return pages.select(key, html).mapInPandas(parsed, ROWS.format(key=key, kind=dict(pages.dtypes)[key]))


class _State(HTMLParser):
    """Collects the text of the script that has an id."""

    def __init__(self, script: str) -> None:
        super().__init__(convert_charrefs=True)
        self.script, self.inside, self.parts = script, False, []

    def handle_starttag(self, tag: str, attrs: list) -> None:
        if tag == "script":
            self.inside = dict(attrs).get("id") == self.script

    def handle_endtag(self, tag: str) -> None:
        if tag == "script":
            self.inside = False

    def handle_data(self, data: str) -> None:
        if self.inside:
            self.parts.append(data)


def embedded_objects(page: str | None, script: str = "ng-state") -> Iterator[dict]:
    """Every object of the JSON state in a page's script, however deep, also in JSON that stands as text within it. A page
    without such a state, or with a broken one, has none."""
    parser = _State(script)
    parser.feed(page or "")
    parser.close()
    try:
        pending = [read_json("".join(parser.parts))]
    except ValueError:
        return
    while pending:
        item = pending.pop()
        if isinstance(item, Members):
            yield dict(item)
            pending.extend(v for _, v in item)
        elif isinstance(item, list):
            pending.extend(item)
        elif isinstance(item, str) and item[:1] in ("{", "["):
            try:
                pending.append(read_json(item))
            except ValueError:
                continue


def sides_of(page: str | None, home: str | None, away: str | None, event: str | None = None) -> tuple[str, str, str] | None:
    """(event, short name of the home side, of the away side) as a page's state gives them for the two names; None if it
    does not, or gives several."""
    found = set()
    for item in embedded_objects(page):
        sides, own = item.get("contestants"), item.get("matchId")
        if not own or isinstance(own, list) or (event and str(own) != event) or not isinstance(sides, list) or len(sides) != 2 or not all(isinstance(s, Members) for s in sides):
            continue
        a, b = map(dict, sides)
        if [a.get("name"), b.get("name")] == [home, away]:
            found.add((str(own), *(str(s.get("shortName") or s["name"]) for s in (a, b))))
    return found.pop() if len(found) == 1 else None


def native_sides(pages: DataFrame, key: str, html: str, home: str, away: str) -> DataFrame:
    """(key, event, home_short, away_short, page_sha256) of every page whose state names the two sides once. Others give no row."""

    def parsed(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            rows = [(k, found, hashlib.sha256(page.encode()).hexdigest()) for k, page, h, a in zip(frame[key], frame[html], frame[home], frame[away], strict=True) if (found := sides_of(page, h, a))]
            yield pd.DataFrame([(k, *found, sha) for k, found, sha in rows], columns=[key, "event", "home_short", "away_short", "page_sha256"])

    return pages.select(key, html, home, away).mapInPandas(parsed, f"{key} {dict(pages.dtypes)[key]}, event string, home_short string, away_short string, page_sha256 string")


def embedded_info(html: Column) -> dict[str, Column]:
    """The match, its time and whether it is live, as a page's state gives them; null where it gives none or several values."""
    live = F.array_distinct(F.transform(F.regexp_extract_all(html, F.lit(r'(?i)"isLive"\s*:\s*(true|false)'), 1), F.lower))
    return {
        "match_id": only_value(html, r'"matchId"\s*:\s*"(\d+)"'),
        "match_time": only_value(html, r'"matchDateUtc"\s*:\s*"([^"\\]+)"'),
        "is_live": F.when(F.size(live) == 1, F.get(live, 0) == "true"),
    }


def route_number(url: Column, hosts: tuple[str, ...]) -> Column:
    """The only ``-m`` number in the path of a URL of one of the hosts; null for any other URL and for several numbers."""
    parts = F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]*)([^?#]*)", 1)
    host = F.lower(F.regexp_extract(parts, r"^(?:[^@]*@)?([^:]*)", 1))
    path = F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]*)([^?#]*)", 2)
    found = F.regexp_extract_all(path, F.lit(r"-m(\d+)(?=$|/)"), 1)
    return F.when(host.isin(*hosts) & (F.size(found) == 1), F.get(found, 0))
