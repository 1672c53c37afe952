"""URL filter: longest-prefix rules by host and path, and a weighted vocabulary counted by an Aho-Corasick automaton.

The host is what lies between the first "://" and the next "/", "?" or "#", with A-Z in lower case; the path follows up
to "?" or "#". A rule (host, path, verdict) fits its host and all subdomains of it if the url's path starts with the
rule's; the longest (host and path together, then the host) wins, and of equal ones a block.

Where no rule fits, the vocabulary decides. One automaton finds all terms in host and path (A-Z in lower case) in one
pass, however many terms there are. A hit counts only at word boundaries: no letter or digit may stand before or after
it, so "casino" is none in "casinova". Each different term adds its weight once; a url is rejected from ``LIMIT`` on,
hence by one strict term (weight 2) or by two different soft ones (weight 1). Query strings are not looked at: they
hold what visitors typed.

Defined results: a null url and one without "://" have an empty host and path and are allowed. Rules and vocabulary are
lists of a size that fits a task. Repeated rows are judged one by one. An empty table gives an empty result. Very long
urls take linear time.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

Rule = tuple[str, str, str]  # host, path, verdict

STRICT_TERMS = (
    "casino casinos poker roulette blackjack slots jackpot betting sportsbook porn porno pornhub xxx hentai milf "
    "nsfw escort escorts camgirls webcamsex sexcam viagra cialis levitra tramadol xanax oxycontin warez keygen "
    "torrents malware phishing ransomware darknet adult-x x-rated adult-video adult-chat link-farm"
).split()
SOFT_TERMS = (
    "adult ads adserver affiliate amateur babes bet bets bonus cams cheap clicks coupon crack cracked dating deals "
    "erotic farm fetish free gamble gambling girls hacked hot hookup inkjet kinky linkfarm loan loans lottery lucky "
    "meds nude nudes payday pharmacy pill pills popup promo replica rolex sex sexy singles spam spins steroids teen "
    "tracker track tracking weightloss win winner"
).split()
STRICT, SOFT, LIMIT = 2, 1, 2
VOCABULARY: dict[str, int] = dict.fromkeys(SOFT_TERMS, SOFT) | dict.fromkeys(STRICT_TERMS, STRICT)


def low(text: str) -> str:
    """A-Z in lower case, all other characters as they are."""
    return text if text.islower() and text.isascii() else text.encode().lower().decode()


def parts(url: str | None) -> tuple[str, str]:
    """Host and path of a url."""
    _, found, rest = (url or "").partition("://")
    if not found:
        return "", ""
    ends = [i for i in map(rest.find, "/?#") if i >= 0]
    host = rest[: min(ends)] if ends else rest
    path = rest[len(host) :]
    ends = [i for i in map(path.find, "?#") if i >= 0]
    return low(host), path[: min(ends)] if ends else path


class Rules:
    """Rules by host and path; a lookup tries the lengths that occur, not the rules."""

    def __init__(self, rules: Iterable[Rule]) -> None:
        self.paths: dict[str, dict[str, str]] = {}
        for host, path, verdict in rules:
            of = self.paths.setdefault(low(host), {})
            if of.get(path) != "block":
                of[path] = verdict
        self.host_lengths = sorted({len(h) for h in self.paths}, reverse=True)
        self.path_lengths = {h: sorted({len(p) for p in of}, reverse=True) for h, of in self.paths.items()}

    def fitting(self, host: str, path: str) -> tuple[str, str] | None:
        """(rule, verdict) of the longest rule that fits."""
        best = None
        for n in self.host_lengths:
            if n > len(host) or n < len(host) and n and host[-n - 1] != ".":
                continue
            named = host[len(host) - n :]
            of = self.paths.get(named)
            if of is None:
                continue
            for m in self.path_lengths[named]:
                if best is not None and n + m <= best[0]:
                    break
                if path[:m] in of and len(path) >= m:
                    best = n + m, named + path[:m], of[path[:m]]
                    break
        return best and best[1:]


class Vocabulary:
    """The terms as one automaton."""

    def __init__(self, weights: dict[str, int]) -> None:
        self.weights = {low(t): w for t, w in weights.items() if t}
        self.automaton = ahocorasick.Automaton()
        for term in self.weights:
            self.automaton.add_word(term, term)
        if self.weights:
            self.automaton.make_automaton()

    def hits(self, text: str) -> list[str]:
        """The different terms that stand in the text as whole words, in alphabetical order."""
        if not self.weights:
            return []
        found = set()
        for last, term in self.automaton.iter(text):
            first = last - len(term)
            if (first < 0 or not text[first].isalnum()) and (last + 1 == len(text) or not text[last + 1].isalnum()):
                found.add(term)
        return sorted(found)

    def score(self, terms: Iterable[str]) -> int:
        return sum(self.weights[t] for t in terms)


FIELDS = [("host", pa.string()), ("path", pa.string()), ("rule", pa.string()), ("verdict", pa.string()), ("terms", pa.list_(pa.string())), ("score", pa.int64())]


def judged(pages: DataFrame, rules: Iterable[Rule], vocabulary: dict[str, int], *carried: str, limit: int = LIMIT) -> DataFrame:
    """(carried columns, host, path, rule, verdict, terms, score) for each row's ``url``; rule is null if none fits."""
    rules = list(rules)
    chosen = pages.select(*(pages[c].alias(f"c{i}") for i, c in enumerate(carried)), pages["url"].alias("url"))
    names = chosen.columns[:-1]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        book, words = Rules(rules), Vocabulary(vocabulary)
        for batch in batches:
            rows = []
            for url in batch.column("url").to_pylist():
                host, path = parts(url)
                terms = words.hits(low(host + path))
                score = words.score(terms)
                rule, verdict = book.fitting(host, path) or (None, "block" if score >= limit else "allow")
                rows.append((host, path, rule, verdict, terms, score))
            found = [pa.array([r[i] for r in rows], kind) for i, (_, kind) in enumerate(FIELDS)]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in names), *found], names=[*names, *(n for n, _ in FIELDS)])

    text, many = T.StringType(), T.ArrayType(T.StringType())
    kinds = dict(host=text, path=text, rule=text, verdict=text, terms=many, score=T.LongType())
    out = T.StructType([*list(chosen.schema)[:-1], *(T.StructField(n, k) for n, k in kinds.items())])
    return chosen.mapInArrow(run, out).toDF(*carried, *kinds)
