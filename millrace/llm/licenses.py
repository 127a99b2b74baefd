"""License detection by ordered signature rules, in DataFrame functions only.

A rule is a regular expression over words: it begins with a literal head word, needs a keyword in the words that follow, has a
label, a priority and a weight. A text first passes a keyword test; only then are its words taken, and rules are tried only
where a head word stands, on as many words as the longest rule can match, and only those whose head and keyword are there. Of overlapping detections
one is suppressed when another of higher priority (or the same priority and more words, or else an earlier rule) contains its
words. Base phrases are detections that are never suppressed.

Everything happens within the row: no join, no shuffle, and work in proportion to the text.

Defined results: null text counts as empty (no words, no labels, score 0); repeated rows are scanned each; equal rules tie by
their order; an empty table gives an empty table; other columns stay out of the result.
"""

from __future__ import annotations

import json
import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from millrace.llm.common import text_of

NON_WORD = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
NON_WORD_ANY_CASE = r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"

#: Keywords of the first test, over the lower-cased text; each rule has one of them in its words.
GATE = r"licen|spdx|gpl|creative[^a-z0-9]+commons|cc[^a-z0-9]+(?:by|0|zero)|public[^a-z0-9]+domain"

#: Fixed values. Base phrases and their labels.
BASE = [("under the mit license", "mit"), ("apache license version 2", "apache-2"), ("cc by nc", "cc-by-nc")]

#: Names of licences, as written after white space and marks became single spaces: label, SPDX words, name patterns.
NAMES: list[tuple[str, str, list[str]]] = [
    ("mit", "mit", ["mit(?: x11)?", "expat", "x11"]),
    ("mit-0", "mit 0", ["mit no attribution"]),
    ("apache-2", "apache 2 0", ["apache(?: software)?(?: version| v)? 2(?: 0)?", "apache(?: software)? license(?: version| v)? 2(?: 0)?"]),
    ("apache-1", "apache 1 1", ["apache(?: software)?(?: version| v)? 1(?: [01])?", "apache(?: software)? license(?: version| v)? 1(?: [01])?"]),
    ("apache", "apache", ["apache(?: software)?"]),
    ("bsd-2", "bsd 2 clause", ["bsd 2 clause", "simplified bsd", "freebsd", "2 clause bsd", "two clause bsd"]),
    ("bsd-3", "bsd 3 clause", ["bsd 3 clause", "new bsd", "modified bsd", "3 clause bsd", "three clause bsd"]),
    ("bsd-4", "bsd 4 clause", ["bsd 4 clause", "original bsd", "4 clause bsd"]),
    ("bsd", "0bsd", ["bsd(?: style)?", "zero clause bsd"]),
    ("isc", "isc", ["isc"]),
    ("gpl-1", "gpl 1 0", ["(?:gnu )?general public license(?: version| v)? 1", "gpl(?: version)? ?v?1"]),
    ("gpl-2", "gpl 2 0", ["(?:gnu )?general public license(?: version| v)? 2", "gplv2", "gpl(?: version| v)? 2", "gnu gpl(?: version| v)? 2"]),
    ("gpl-3", "gpl 3 0", ["(?:gnu )?general public license(?: version| v)? 3", "gplv3", "gpl(?: version| v)? 3", "gnu gpl(?: version| v)? 3"]),
    ("gpl", "gpl", ["gnu general public", "gnu gpl", "gpl"]),
    ("lgpl-2", "lgpl 2 1", ["lgplv2", "lgpl(?: version| v)? 2(?: [01])?", "gnu lesser general public license(?: version| v)? 2(?: [01])?"]),
    ("lgpl-3", "lgpl 3 0", ["lgplv3", "lgpl(?: version| v)? 3", "gnu lesser general public license(?: version| v)? 3"]),
    ("lgpl", "lgpl", ["gnu lesser general public", "gnu library general public", "gnu lgpl", "lgpl"]),
    ("agpl-3", "agpl 3 0", ["agplv3", "agpl(?: version| v)? 3", "gnu affero general public license(?: version| v)? 3"]),
    ("agpl", "agpl", ["gnu affero general public", "affero general public", "agpl"]),
    ("mpl-1", "mpl 1 1", ["mozilla public license(?: version| v)? 1(?: [01])?", "mpl 1(?: [01])?"]),
    ("mpl-2", "mpl 2 0", ["mozilla public license(?: version| v)? 2(?: 0)?", "mpl 2(?: 0)?"]),
    ("mpl", "mpl", ["mozilla public"]),
    ("epl-1", "epl 1 0", ["eclipse public license(?: version| v)? 1(?: 0)?"]),
    ("epl-2", "epl 2 0", ["eclipse public license(?: version| v)? 2(?: 0)?"]),
    ("epl", "epl", ["eclipse public"]),
    ("cddl", "cddl 1 0", ["common development and distribution"]),
    ("eupl", "eupl 1 2", ["european union public", "eupl"]),
    ("artistic-2", "artistic 2 0", ["artistic(?: version)? 2(?: 0)?", "perl artistic", "artistic"]),
    ("bsl", "bsl 1 0", ["boost software", "boost"]),
    ("zlib", "zlib", ["zlib", "zlib libpng"]),
    ("libpng", "libpng 2 0", ["libpng"]),
    ("python", "python 2 0", ["python software foundation", "psf"]),
    ("ruby", "ruby", ["ruby"]),
    ("php", "php 3 01", ["php"]),
    ("openssl", "openssl", ["openssl"]),
    ("postgresql", "postgresql", ["postgresql"]),
    ("ofl", "ofl 1 1", ["sil open font", "open font"]),
    ("odbl", "odbl 1 0", ["open database", "open data commons open database"]),
    ("pddl", "pddl 1 0", ["open data commons public domain dedication and"]),
    ("upl", "upl 1 0", ["universal permissive"]),
    ("ncsa", "ncsa", ["university of illinois ncsa open source", "ncsa"]),
    ("wtfpl", "wtfpl", ["wtfpl"]),
    ("ms-pl", "ms pl", ["microsoft public"]),
    ("ms-rl", "ms rl", ["microsoft reciprocal"]),
    ("afl", "afl 3 0", ["academic free"]),
    ("osl", "osl 3 0", ["open software"]),
    ("gfdl", "gfdl 1 3", ["gnu free documentation"]),
    ("cpl", "cpl 1 0", ["common public"]),
    ("ecl", "ecl 2 0", ["educational community"]),
    ("unlicense", "unlicense", ["unlicense"]),
    ("proprietary", "licenseref proprietary", ["proprietary", "commercial"]),
]

#: Creative Commons: words after "cc" or "creative commons", label.
COMMONS = [("by", "cc-by"), ("by sa", "cc-by-sa"), ("by nc", "cc-by-nc"), ("by nd", "cc-by-nd"), ("by nc sa", "cc-by-nc-sa"), ("by nc nd", "cc-by-nc-nd"), ("0", "cc0"), ("zero", "cc0")]
COMMONS_LONG = [
    ("attribution", "cc-by"), ("attribution share ?alike", "cc-by-sa"), ("attribution non ?commercial", "cc-by-nc"), ("attribution no ?derivs", "cc-by-nd"), ("attribution no ?derivatives", "cc-by-nd"),
    ("attribution non ?commercial share ?alike", "cc-by-nc-sa"), ("attribution non ?commercial no ?derivs", "cc-by-nc-nd"), ("attribution non ?commercial no ?derivatives", "cc-by-nc-nd"), ("zero", "cc0"),
]
COMMONS_END = "(?: \\d(?: \\d)?)?(?: (?:international|unported))?"
#: What hints at a licence without naming one: pattern, label, priority, weight.
GENERAL = [
    ("creative commons(?: licen[cs]e)?", "creative-commons", 1, 0.5), ("public domain(?: dedication)?", "public-domain", 2, 0.6), ("open source licen[cs]e", "unknown-license", 1, 0.3),
    ("free software licen[cs]e", "unknown-license", 1, 0.3), ("see (?:the )?licen[cs]e(?: file)?", "unknown-license", 1, 0.3), ("license agreement", "unknown-license", 1, 0.3), ("end user licen[cs]e agreement", "unknown-license", 1, 0.3),
]
LEADS = ["licensed", "released", "distributed", "available", "published", "provided", "redistributed", "covered", "governed"]


def _keyword(pattern: str) -> str:
    """The longest literal word that every match has."""
    fixed = re.sub(r"\(\?:[^)]*\)\??|\[[^]]*\]|\S? ?\?\S*", " ", re.sub(r"\(\?:[^)]*\)\?", " ", pattern))
    return max(fixed.split(), key=len)


def rules() -> list[tuple[str, str, str, str, int, float, bool]]:
    """(head, keyword, regex, label, priority, weight, base), in order. The regex is over " word word ... " from the head on."""
    out: list[tuple[str, str, str, str, int, float, bool]] = []

    def add(pattern: str, label: str, priority: int, weight: float, base: bool = False) -> None:
        head = re.match(r"[a-z0-9]+", pattern)[0]
        out.append((head, _keyword(pattern), f"^ {pattern}(?= )", label, priority, weight, base))

    licence, version = " licen[cs]e", "(?: version \\d(?: \\d)?)?"
    for phrase, label in BASE:
        add(phrase, label, 9, 1.0, True)
    for label, spdx, names in NAMES:
        add(f"spdx license identifier {spdx}(?: (?:only|or later))?", label, 8, 1.0)
        for name in names:
            named = name if "license" in name else name + licence
            exact = label[-1].isdigit()
            for lead in LEADS:
                loose = f"{named[: -len(licence)]}(?:{licence})?" if named.endswith(licence) and (lead == "licensed" or "gpl" in name) else named
                add(f"{lead} under (?:the )?(?:terms of (?:the )?)?{loose}{version}(?: or later)?", label, 7, 0.95)
            if name.startswith("(?:gnu )?"):
                add(name.removeprefix("(?:gnu )?"), label, 5, 0.85)
                add(name.replace("(?:gnu )?", "gnu "), label, 5, 0.9)
            else:
                add(f"{named}{version}", label, 5 if exact else 4, 0.9)
    for words, label in COMMONS:
        add(f"cc {words}{COMMONS_END}", label, 6, 0.9)
        add(f"licensed under (?:a |the )?cc {words}{COMMONS_END}(?:{licence})?", label, 7, 0.95)
        add(f"under (?:a |the )?cc {words}{COMMONS_END}(?:{licence})?", label, 7, 0.95)
    for words, label in COMMONS_LONG:
        add(f"creative commons {words}{COMMONS_END}(?: public)?(?:{licence})?", label, 6, 0.9)
    for pattern, label, priority, weight in GENERAL:
        add(pattern, label, priority, weight)
    return list(dict.fromkeys(out))


def longest(table: list[tuple]) -> int:
    """Words that a rule can match at most: no rule repeats without bound, so there is a space in it for each word."""
    return max((r[2].count(" ") - 1 for r in table), default=1)


def _literal(table: list[tuple]) -> Column:
    """Rules by head word, as a constant map."""
    heads: dict[str, list[dict]] = {}
    for k, (head, keyword, regex, label, priority, weight, base) in enumerate(table):
        heads.setdefault(head, []).append({"id": k, "kw": keyword, "rx": regex, "label": label, "prio": priority, "weight": weight, "base": base})
    return F.from_json(F.lit(json.dumps(heads)), "map<string, array<struct<id: int, kw: string, rx: string, label: string, prio: int, weight: double, base: boolean>>>")


def scan(docs: DataFrame, text: str = "text", key: str = "doc_id", table: list[tuple] | None = None) -> DataFrame:
    """key, n_words, detections (array of start, stop, label, prio, weight, base, id; after suppression, in order of start)."""
    table = rules() if table is None else table
    heads = F.array(*[F.lit(h) for h in dict.fromkeys(r[0] for r in table)])
    by_head = _literal(table)
    per_head = max((sum(r[0] == h for r in table) for h in {r[0] for r in table}), default=1)
    window = longest(table)
    reach = window * per_head  # detections that can begin within a window before a place
    t = text_of(text)
    upper, lower = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
    ws = docs.select(
        F.col(key),
        F.size(F.array_remove(F.split(t, NON_WORD_ANY_CASE), "")).cast("long").alias("n_words"),
        F.when(F.lower(t).rlike(GATE), F.array_remove(F.split(F.translate(t, upper, lower), NON_WORD), "")).alias("ws"),
    )
    places = F.filter(F.sequence(F.lit(0), F.greatest(F.size("ws") - 1, F.lit(0))), lambda i: F.array_contains(heads, F.get(F.col("ws"), i)))
    cands = ws.select(
        key, "n_words", F.when(F.size("ws") > 0, F.transform(places, lambda i: F.struct(i.cast("long").alias("at"), F.get(F.col("ws"), i).alias("head"), F.concat(F.lit(" "), F.array_join(F.slice(F.col("ws"), i + 1, window), " "), F.lit(" ")).alias("win")))).alias("cands")
    )

    def tried(c: Column) -> Column:
        fits = F.filter(F.element_at(by_head, c["head"]), lambda r: F.contains(c["win"], r["kw"]) & F.regexp_like(c["win"], r["rx"]))
        return F.transform(
            fits,
            lambda r: F.struct(
                c["at"].alias("start"), (c["at"] - 1 + F.length(F.regexp_extract_all(c["win"], r["rx"], F.lit(0))[0]) - F.length(F.replace(F.regexp_extract_all(c["win"], r["rx"], F.lit(0))[0], F.lit(" "), F.lit("")))).alias("stop"),
                r["prio"].alias("prio"), r["id"].alias("id"), r["label"].alias("label"), r["weight"].alias("weight"), r["base"].alias("base"),
            ),
        )

    hits = cands.select(key, "n_words", F.array_sort(F.flatten(F.transform("cands", tried))).alias("hits"))

    def stays(h: Column, i: Column) -> Column:
        near = F.slice(F.col("hits"), F.greatest(F.lit(1), i + 1 - reach), 2 * reach + 1)
        wins = lambda g: (g["prio"] > h["prio"]) | ((g["prio"] == h["prio"]) & ((g["stop"] - g["start"] > h["stop"] - h["start"]) | ((g["stop"] - g["start"] == h["stop"] - h["start"]) & (g["id"] < h["id"]))))
        return h["base"] | ~F.exists(near, lambda g: (g["start"] <= h["start"]) & (g["stop"] >= h["stop"]) & wins(g))

    return hits.select(key, "n_words", F.coalesce(F.filter("hits", stays), F.lit([]).cast(hits.schema["hits"].dataType)).alias("detections"))


def summary(docs: DataFrame, text: str = "text", key: str = "doc_id") -> DataFrame:
    """key, n_words, n_base, first_word, last_word, base_labels, labels, score."""
    found = scan(docs, text, key)
    base = F.filter("detections", lambda d: d["base"])
    joined = lambda a: F.array_join(F.array_sort(F.array_distinct(F.transform(a, lambda d: d["label"]))), ",")
    starts = F.transform(base, lambda d: d["start"])
    return found.select(
        key, "n_words", F.size(base).cast("long").alias("n_base"), F.array_min(starts).alias("first_word"), F.array_max(starts).alias("last_word"), joined(base).alias("base_labels"), joined(F.col("detections")).alias("labels"),
        F.coalesce(F.array_max(F.transform("detections", lambda d: d["weight"])), F.lit(0.0)).alias("score"),
    )
