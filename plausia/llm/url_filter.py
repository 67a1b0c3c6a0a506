"""URL filters: host and path rules, and a weighted vocabulary of URL terms found by one Aho-Corasick pass.

The vocabulary is a table of terms (term, weight); a weight of null marks a strict term. A term counts only between boundaries:
the characters before and after it are no ASCII letter or digit. One strict term rejects a URL; so do several distinct soft terms
whose weights, each term counted once, reach SOFT_LIMIT: the surer a term is a sign, the fewer others it needs, but none is
enough alone. A rule of the list, where one fits, overrides the vocabulary: it fits its host and all subdomains if the URL's path
starts with the rule's path, and the longest rule wins. Rules are looked up by the host's suffixes, so the cost of a URL
doesn't grow with the list. Rules and vocabulary are sent to every task; they may have MAX_TERMS entries, more are refused.

Defined results: a null URL, or one without `://`, has an empty host and path, no rule, and is judged by the vocabulary
(a null URL is allowed); null and empty terms are left out, and a term that is there twice counts with its largest weight, strict above
all; an empty vocabulary rejects nothing; repeated rows are judged each; a null page_id stays null. Other columns of the
input, whatever their names, are neither read nor returned.
"""

from __future__ import annotations

from collections.abc import Iterator

import ahocorasick
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession, functions as F

from plausia.llm.common import cached_for, ready, table, turn_to

#: (host and path, verdict).
RULES = (("com/", "allow"), ("example.com/en/", "block"), ("www.example.com/en/", "allow"), ("net/es/", "block"), ("net/fr/", "block"))
#: The vocabulary that is used if none is given: strict terms, then soft ones by weight.
VOCABULARY = {
    None: "adult casino escort gambling hentai malware nsfw phishing porn porno sex slots spam viagra xxx",
    1.5: "betting crack dating jackpot keygen lottery pills poker replica torrent warez",
    1.0: "ads bet bets bonus cam cheap clickbait loan loans popup win winner",
    0.5: "deal diet farm free hot track tracker",
}
SOFT_LIMIT, LEAST_SOFT, MAX_TERMS = 2.0, 2, 1_000_000
_WORD = frozenset("abcdefghijklmnopqrstuvwxyz0123456789")
_LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def parts(url: str | None) -> tuple[str, str]:
    """Host, A-Z lower-cased, and path."""
    _, mark, rest = (url or "").partition("://")
    if not mark:
        return "", ""
    end = min([i for c in "/?#" if (i := rest.find(c)) >= 0], default=len(rest))
    host, rest = rest[:end].translate(_LOWER), rest[end:]
    end = min([i for c in "?#" if (i := rest.find(c)) >= 0], default=len(rest))
    return host, rest[:end]


class UrlFilter:
    """Rules by host, and the automaton of the vocabulary."""

    def __init__(self, rules, terms: list[tuple[str, float | None]], soft_limit: float = SOFT_LIMIT):
        self.by_host: dict[str, list[tuple[str, str, str]]] = {}
        for rule, verdict in rules:
            host, slash, path = rule.partition("/")
            self.by_host.setdefault(host, []).append((slash + path, rule, verdict))
        for found in self.by_host.values():
            found.sort(key=lambda x: (-len(x[0]), x[1]))
        self.soft_limit = soft_limit
        self.automaton = ahocorasick.Automaton()
        for term, weight in terms:
            self.automaton.add_word(term, (term, len(term), weight))
        self.automaton.make_automaton()

    def rule(self, host: str, path: str) -> tuple[str, str] | None:
        """The longest rule that fits, and its verdict."""
        best = None
        at = 0
        while host:
            for prefix, rule, verdict in self.by_host.get(host[at:], ()):
                if path.startswith(prefix):
                    if best is None or len(rule) > len(best[0]):
                        best = (rule, verdict)
                    break
            dot = host.find(".", at)
            if dot < 0:
                break
            at = dot + 1
        return best

    def hits(self, url: str) -> dict[str, float | None]:
        """The distinct terms between boundaries, with their weights."""
        s, found = url.translate(_LOWER), {}
        if not len(self.automaton):
            return found
        for end, (term, n, weight) in self.automaton.iter(s):
            if (end - n < 0 or s[end - n] not in _WORD) and (end + 1 == len(s) or s[end + 1] not in _WORD):
                found[term] = weight
        return found

    def judge(self, url: str | None) -> tuple[str, str, str | None, str, int, float]:
        host, path = parts(url)
        rule = self.rule(host, path)
        found = self.hits(url or "")
        soft = [w for w in found.values() if w is not None]
        weight = float(sum(soft))
        rejected = len(soft) < len(found) or len(soft) >= LEAST_SOFT and weight >= self.soft_limit
        return host, path, rule[0] if rule else None, rule[1] if rule else "block" if rejected else "allow", len(found), weight


_FILTERS: dict[str, UrlFilter] = {}
cached_for("urls", _FILTERS.clear)


def _judged(rules, terms: list[tuple[str, float | None]], soft_limit: float, key: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        turn_to("urls")
        f = _FILTERS.get(key)
        if f is None:
            _FILTERS.clear()
            f = _FILTERS[key] = UrlFilter(rules, terms, soft_limit)
        for b in batches:
            got = [f.judge(u) for u in b.column("url").to_pylist()]
            host, path, rule, verdict, n, weight = zip(*got, strict=True) if got else ((),) * 6
            columns = [*(pa.array(x, pa.string()) for x in (host, path, rule, verdict)), pa.array(n, pa.int32()), pa.array(weight, pa.float64())]
            yield pa.RecordBatch.from_arrays([b.column("page_id"), *columns], ["page_id", "host", "path", "rule", "verdict", "n_terms", "soft_weight"])

    return run


def vocabulary(spark: SparkSession) -> DataFrame:
    """VOCABULARY as a table."""
    return spark.createDataFrame([(t, w) for w, ts in VOCABULARY.items() for t in ts.split()], "term string, weight double")


def terms_of(words: DataFrame) -> list[tuple[str, float | None]]:
    """A vocabulary's terms, lower case, once each."""
    term = F.lower(F.col("term"))
    by = words.filter("term is not null and term <> ''").groupBy(term.alias("term")).agg(F.bool_or(F.col("weight").isNull()).alias("strict"), F.max("weight").alias("weight"))
    rows = by.limit(MAX_TERMS + 1).collect()
    if len(rows) > MAX_TERMS:
        raise ValueError(f"the vocabulary has over {MAX_TERMS} terms")
    return sorted(((r.term, None if r.strict else float(r.weight)) for r in rows), key=lambda x: x[0])


def judged(spark: SparkSession, pages: DataFrame, rules=RULES, words: DataFrame | None = None, soft_limit: float = SOFT_LIMIT) -> DataFrame:
    """page_id, host, path, rule, verdict, n_terms and soft_weight for every row of pages."""
    ready(spark)
    if len(rules) > MAX_TERMS:
        raise ValueError(f"over {MAX_TERMS} rules")
    terms = terms_of(vocabulary(spark) if words is None else words)
    key = xxhash.xxh64_hexdigest(repr((rules, terms, soft_limit)))
    rows = pages.select(F.col("page_id").cast("long"), F.col("url").cast("string"))
    return rows.mapInArrow(_judged(rules, terms, soft_limit, key), "page_id long, host string, path string, rule string, verdict string, n_terms int, soft_weight double")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judged(spark, table(spark, sf_dir, "pages"))


def _hit(term: str) -> str:
    return f"regexp_matches(u, '(^|[^a-z0-9]){term}([^a-z0-9]|$)')::INT"


_RULE_SQL = " ".join(
    f"WHEN (host = '{h}' OR ends_with(host, '.{h}')) AND starts_with(path, '/{p}') THEN '{h}/{p}'"
    for h, _, p in (r.partition("/") for r, _ in sorted(RULES, key=lambda x: -len(x[0])))
)
_SOFT = [(t, w) for w, ts in VOCABULARY.items() if w is not None for t in ts.split()]
ORACLE_SQL = rf"""
WITH p AS (SELECT page_id, url, translate(coalesce(url, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS u,
        CASE WHEN contains(url, '://') THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest FROM pages),
h AS (SELECT page_id, u, translate(regexp_extract(rest, '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
        regexp_extract(substr(rest, length(regexp_extract(rest, '^[^/?#]*')) + 1), '^[^?#]*') AS path FROM p),
r AS (SELECT page_id, host, path, CASE {_RULE_SQL} END AS rule, {' + '.join(map(_hit, VOCABULARY[None].split()))} AS strict,
        {' + '.join(f'{w} * {_hit(t)}' for t, w in _SOFT)} AS weight, {' + '.join(_hit(t) for t, _ in _SOFT)} AS n_soft FROM h)
SELECT page_id, host, path, rule, CASE rule {' '.join(f"WHEN '{r}' THEN '{v}'" for r, v in RULES)}
  ELSE CASE WHEN strict > 0 OR n_soft >= {LEAST_SOFT} AND weight >= {SOFT_LIMIT} THEN 'block' ELSE 'allow' END END AS verdict, (strict + n_soft)::INT AS n_terms, weight::DOUBLE AS soft_weight FROM r
"""
