"""URL filters: pattern rules indexed by their rarest literal token."""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._common import table

_TOKEN = re.compile(r"[a-z0-9]+")


@dataclass(frozen=True)
class Rule:
    """``pattern`` is searched in host + path. ``text`` names the rule; of all that match, the longest text wins (ties:
    the smaller one). ``tokens`` are whole tokens that every matching URL holds; a rule without any is always tried."""

    text: str
    pattern: str
    verdict: str
    tokens: tuple[str, ...]


def host_rule(host: str, path: str, verdict: str) -> Rule:
    """``host`` and its subdomains, with paths that start with ``path``. What ends the path may go on in the URL, so its
    last token counts only if something stands behind it."""
    closed = _TOKEN.findall(host.lower())
    inner = re.sub(r"[A-Za-z0-9]+$", "", path)
    closed += [x for x in re.findall(r"[A-Za-z0-9]+", inner) if _TOKEN.fullmatch(x)]
    return Rule(host + path, rf"^(?:[^/?#]*\.)?{re.escape(host.lower())}{re.escape(path)}", verdict, tuple(dict.fromkeys(closed)))


def word_rule(word: str, verdict: str) -> Rule:
    """Hosts of which a label holds ``word`` between its ends or hyphens."""
    return Rule(word, rf"^(?:[^/?#]*[.-])?{re.escape(word)}(?:[.-][^/?#]*)?(?:[/?#]|$)", verdict, tuple(_TOKEN.findall(word)))


#: The production rules. Host and path rules first; words of hosts decide only where none of those fits.
HOST_RULES = (
    host_rule("com", "/en/", "block"),
    host_rule("example.com", "/en/7", "allow"),
    host_rule("net", "/de/", "allow"),
    host_rule("example.net", "/de/8", "block"),
    host_rule("org", "/es/", "block"),
)
WORDS = "ads adserver adult bets betting casino casinos escort escorts gambling jackpot malware phishing poker porn roulette slots spam viagra warez xxx".split()
WORD_RULES = tuple(word_rule(w, "block") for w in WORDS)


def split_url(url: str | None) -> tuple[str, str]:
    """Host (A-Z lower-cased) and path; both empty for null or without ``://``."""
    head, mark, rest = (url or "").partition("://")
    if not mark:
        return "", ""
    host = re.match(r"[^/?#]*", rest)[0]
    path = re.match(r"[^?#]*", rest[len(host) :])[0]
    return host.translate(_LOWER), path


_LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def rarest_index(rules: tuple[Rule, ...], counts: dict[str, int]) -> dict[str | None, list[tuple[Rule, re.Pattern]]]:
    """Rules by their rarest token (ties by name); None holds those without one."""
    index: dict[str | None, list] = {}
    for rule in rules:
        token = min(rule.tokens, key=lambda t: (counts.get(t, 0), t), default=None)
        index.setdefault(token, []).append((rule, re.compile(rule.pattern)))
    return index


def token_counts(urls: DataFrame, tokens: set[str]) -> dict[str, int]:
    """In how many of ``urls`` (url) each of the rules' own tokens stands; no more rows than rules reach the driver."""
    split = F.array_distinct(F.split(F.lower("url"), "[^a-z0-9]+"))
    wanted = F.array_intersect(split, F.array(*(F.lit(t) for t in sorted(tokens))))
    rows = urls.where("url is not null").select(F.explode(wanted).alias("token")).groupBy("token").agg(F.count("*").alias("n")).collect()
    return {r.token: r.n for r in rows}


def judge(pages: DataFrame, *tiers: tuple[Rule, ...], default: str = "allow") -> DataFrame:
    """``pages`` with host, path, rule, verdict and tier (all columns of ``pages`` stay; of those names are replaced).

    The tokens of a URL fetch the candidate rules from the index, and only those run their regular expressions. The
    first tier with a match decides, in it the longest rule. Without any match the verdict is ``default`` and rule is
    null. Nothing is shuffled. Repeated rows each come back alike, a very long url is whole, and an empty table gives no
    rows. A null url, or one without ``://``, has empty host and path and matches rules that match
    the empty string alone.
    """
    counts = token_counts(pages.select("url"), {t for rules in tiers for r in rules for t in r.tokens})
    added = ("host", "path", "rule", "verdict", "tier")
    kept = [c for c in pages.columns if c not in added]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        indexes = [rarest_index(rules, counts) for rules in tiers]
        for batch in batches:
            out = []
            for url in batch.column(1).to_pylist():
                host, path = split_url(url)
                whole, found, level = host + path, None, None
                tokens = [None, *dict.fromkeys(_TOKEN.findall(whole))]
                for level, index in enumerate(indexes):
                    fits = [rule for t in tokens for rule, pattern in index.get(t, ()) if pattern.search(whole)]
                    if fits:
                        found = min(fits, key=lambda r: (-len(r.text), r.text))
                        break
                out.append((host, path, found and found.text, found.verdict if found else default, level if found else None))
            columns = list(zip(*out, strict=True)) or [()] * 5
            kinds = (pa.string(), pa.string(), pa.string(), pa.string(), pa.int32())
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(c, k) for c, k in zip(columns, kinds, strict=True))], ["row", *added])

    rows = pages.select(F.struct(*(pages[c] for c in kept)).alias("row"), F.col("url").cast("string").alias("url"))
    kind = rows.schema["row"].dataType.simpleString()
    return rows.mapInArrow(run, f"row {kind}, host string, path string, rule string, verdict string, tier int").select("row.*", *added)


def op1_urls(spark, sf_dir: str) -> DataFrame:
    """The verdict on every page's URL; see ``judge``."""
    found = judge(table(spark, sf_dir, "pages").select("page_id", "url"), HOST_RULES, WORD_RULES)
    return found.select("page_id", "host", "path", F.when(F.col("tier") == 0, F.col("rule")).alias("rule"), "verdict")


ORACLE = r"""
WITH u AS (SELECT page_id, CASE WHEN contains(url, '://') THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest FROM pages),
p AS (SELECT page_id, translate(regexp_extract(rest, '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
             regexp_extract(substr(rest, length(regexp_extract(rest, '^[^/?#]*')) + 1), '^[^?#]*') AS path FROM u),
rules(rhost, rpath, rverdict) AS (VALUES ('com', '/en/', 'block'), ('example.com', '/en/7', 'allow'), ('net', '/de/', 'allow'),
             ('example.net', '/de/8', 'block'), ('org', '/es/', 'block')),
fits AS (SELECT page_id, arg_max(rhost || rpath, length(rhost || rpath)) AS rule, arg_max(rverdict, length(rhost || rpath)) AS verdict
         FROM p, rules WHERE (host = rhost OR ends_with(host, '.' || rhost)) AND starts_with(path, rpath) GROUP BY 1)
SELECT p.page_id, host, path, rule,
       coalesce(verdict, CASE WHEN regexp_matches(host, '(^|[.-])(WORDS)($|[.-])') THEN 'block' ELSE 'allow' END) AS verdict
FROM p LEFT JOIN fits USING (page_id)
""".replace("WORDS", "|".join(WORDS))
