"""URL filter: host rules, and logistic regression on hashed character n-grams. DataFrame functions only."""

from __future__ import annotations

import json
import math
from collections.abc import Sequence
from typing import NamedTuple

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


class Rule(NamedTuple):
    host: str
    path: str
    verdict: str


#: The rules of the registered query.
RULES = (
    Rule("org", "/", "allow"),
    Rule("example.org", "/es/", "block"),
    Rule("example.org", "/en/1", "block"),
    Rule("com", "/fr/", "allow"),
    Rule("com", "/de/", "block"),
)

#: Names of hosts in the labelled table, general words of both kinds: 1 is to be blocked.
UNWANTED = """
casino poker slots roulette jackpot bets betting bookmaker lottery gambling adult porn xxx escort singles dating camgirls nude
pills pharmacy viagra cialis steroids replica counterfeit payday loans creditfix getrich forexbot cryptodoubler prizewinner
freegift giftcard clickbait popunder adserver adtracker trackpixel bannerads linkfarm spamlist contentfarm doorway phishing
malware cracked warez keygen torrentz hackedmods fakeid
""".split()
WANTED = """
news library university weather recipes documentation history museum science journal travel guide market garden hiking chess
software addresses theatre national education foundation health hospital school council government parliament archive encyclopedia
dictionary translation language literature poetry novels authors bookshop music orchestra painting gallery photography cinema
architecture engineering mathematics physics chemistry biology medicine nursing nutrition cooking bakery restaurant hotel railway
airport cycling football tennis swimming athletics mountain river forest wildlife animals birds insects oceans climate geology
astronomy weathermap farming forestry fishing harbour construction furniture carpentry knitting clothing fashion shoes jewellery
insurance accounting banking economics business industry transport energy electricity waterworks recycling community charity church
village tourism heritage genealogy family children parenting teaching training research laboratory computing programming database
network security hardware robotics statistics opinion magazine radio television station weekly
""".split()
PATHS = ("", "index.html", "about/", "article/{n}", "en/{n}", "de/{n}.html", "fr/{n}/", "es/{n}?page=2", "2021/05/{n}", "p?id={n}", "blog/{n}#top", "category/{n}/item")


#: Paths of the labelled table that are to be blocked whatever the host: what they lead to, where they send on, and machine-made runs.
UNWANTED_PATHS = (
    "casino/{n}", "play/slots/{n}", "free-spins/bonus-{n}", "xxx/videos/{n}.html", "adult/gallery-{n}", "hot-singles/{n}", "buy-cheap-pills/{n}", "viagra-online.php?id={n}",
    "redirect?url={n}", "redir.php?to={n}", "out/click/{n}", "go.php?u={n}", "track/click?id={n}", "adclick/{n}", "popunder/{n}.js", "banner/ads/{n}",
    "download/crack-{n}.exe", "keygen/{n}.zip", "warez/full-{n}.rar", "torrent/{n}.magnet", "win-prize/claim-{n}", "free-gift/claim?c={n}", "wp-login/verify-account-{n}", "secure-update/login.php?s={n}",
    "{n}{n}{n}{n}/", "x/{n}{n}{n}.html", "t/{n}{n}{n}{n}{n}", "aff?sid={n}{n}{n}", "loan-offers/{n}", "crypto-doubler/{n}", "forex-signals/{n}", "sms/prizewinner-{n}",
)


def labelled_rows() -> list[tuple[str, int, int]]:
    """url, label (1: to be blocked) and the number of the word or path that it is made of.

    Unwanted names with ordinary paths, ordinary names with unwanted paths, and ordinary names with ordinary paths.
    """
    rows, tops = [], ("com", "net", "org")
    for label, names in ((1, UNWANTED), (0, WANTED)):
        for k, name in enumerate(names):
            mate = names[(7 * k + 3) % len(names)]
            for j, host in enumerate((name, f"www.{name}-{mate}", f"{('m', 'blog', 'shop')[k % 3]}.{mate}{name}")):
                path = PATHS[(k + 5 * j) % len(PATHS)].format(n=137 * k + 31 * j + 2)
                rows.append((f"{('http', 'https')[j % 2]}://{host}.example.{tops[(k + j) % 3]}/{path}", label, k))
    for k, form in enumerate(UNWANTED_PATHS):
        for j in range(6):
            name = WANTED[(11 * k + 29 * j) % len(WANTED)]
            host = (name, f"www.{name}", f"blog.{name}")[j % 3]
            rows.append((f"{('http', 'https')[j % 2]}://{host}.example.{tops[(k + j) % 3]}/{form.format(n=7919 * (k + 1) * (j + 2) % 9973)}", 1, k))
    for label, names in ((1, UNWANTED), (0, WANTED)):
        for k, name in enumerate(names):
            for j in range(4 - label):  # names of both kinds and the same numbers on ordinary paths
                form = PATHS[(k + 3 * j + 1) % len(PATHS)]
                host = (name, f"www.{name}", f"blog.{name}", f"m.{name}")[j]
                rows.append((f"{('http', 'https')[j % 2]}://{host}.example.{tops[(k + j) % 3]}/{form.format(n=7919 * (k + 1) * (j + 2) % 9973)}", label, k))
    return rows


def labelled_urls(spark: SparkSession) -> DataFrame:
    """The small labelled table: url, label (1: to be blocked)."""
    return spark.sql("SELECT * FROM VALUES " + ", ".join(f"('{u}', {y})" for u, y, _ in labelled_rows()) + " AS t(url, label)")


def parts(url: Column) -> tuple[Column, Column]:
    """Host (A-Z lower-cased) and path; both empty without ``://``, and for null."""
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise(F.lit(""))
    host = F.regexp_extract(rest, r"^[^/?#]*", 0)
    path = F.regexp_extract(F.substring(rest, F.length(host) + 1, F.length(rest)), r"^[^?#]*", 0)
    lower = F.translate(host, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    return F.coalesce(lower, F.lit("")), F.coalesce(path, F.lit(""))


def ruled(host: Column, path: Column, rules: Sequence[Rule]) -> tuple[Column, Column]:
    """The longest rule that fits, and its verdict; null where none fits."""
    name, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for r in sorted(rules, key=lambda r: len(r.host + r.path)):
        fits = ((host == r.host) | host.endswith("." + r.host)) & path.startswith(r.path)
        name, verdict = F.when(fits, r.host + r.path).otherwise(name), F.when(fits, r.verdict).otherwise(verdict)
    return name, verdict


def grams(host: Column, path: Column, lengths: Sequence[int], slots: int) -> Column:
    """Slots of the character n-grams of host and path, which are told apart by their marks."""

    def of(text: Column, n: int) -> Column:
        last = F.length(text) - (n - 1)
        at = F.when(last >= 1, F.sequence(F.lit(1), last)).otherwise(F.array().cast("array<int>"))
        return F.transform(at, lambda i: F.pmod(F.xxhash64(F.substring(text, i, F.lit(n))), F.lit(slots)).cast("int"))

    marked = (F.concat(F.lit("\x02"), host, F.lit("\x03")), F.concat(F.lit("\x04"), path, F.lit("\x05")))
    return F.concat(*(of(t, n) for t in marked for n in lengths))


def train(labelled: DataFrame, *, lengths: Sequence[int] = (3, 4), slots: int = 1 << 12, rounds: int = 40, rate: float = 0.5, decay: float = 1e-3, block_share: float = 0.35, most_rows: int = 10_000) -> tuple[float, list[float]]:
    """Bias and slot weights of a logistic regression.

    ``labelled`` (url, label) is a small table by contract; at most ``most_rows`` of its
    rows, in url order, are used, and their slots come to the driver. The rows to be
    blocked have ``block_share`` of the weight, so that what the model knows nothing of is
    rather allowed. Null urls count as empty. Without rows of both labels all weights are 0.
    """
    host, path = parts(F.col("url"))
    rows = labelled.where("label IS NOT NULL").orderBy("url", "label").limit(most_rows).select(grams(host, path, lengths, slots).alias("slots"), F.col("label").cast("double")).collect()
    weights, bias = np.zeros(slots), 0.0
    if len({y for _, y in rows}) < 2:
        return bias, weights.tolist()
    share = sum(y for _, y in rows) / len(rows)
    counted = [(*np.unique(np.array(at, int), return_counts=True), 1 / math.sqrt(len(at) or 1), y) for at, y in rows]
    for k in range(rounds):
        step = rate / (1 + 0.1 * k)
        for at, n, unit, y in counted:
            margin = bias + unit * float(weights[at] @ n)
            slope = 1 / (1 + math.exp(-max(-30.0, min(30.0, margin)))) - y
            slope *= block_share / share if y else (1 - block_share) / (1 - share)
            bias -= step * slope * 0.1
            weights[at] -= step * n * (slope * unit + decay * weights[at])
    return bias, np.round(weights, 6).tolist()


def judge(pages: DataFrame, model: tuple[float, list[float]], rules: Sequence[Rule] = RULES, *, lengths: Sequence[int] = (3, 4)) -> DataFrame:
    """page_id, host, path, rule, score, verdict of every row; no shuffle, only url and page_id are read.

    The verdict is the longest fitting rule's, else ``block`` where the model's
    probability is 0.5 or more. Null, empty and odd urls have empty host and path and are
    judged by the model's bias alone; repeated rows are judged alike.
    """
    bias, weights = model
    host, path = parts(F.col("url"))
    split = pages.select("page_id", host.alias("host"), path.alias("path"))
    slots = grams(F.col("host"), F.col("path"), lengths, len(weights))
    learned = F.from_json(F.lit(json.dumps(weights)), "array<double>")
    margin = F.aggregate("slots", F.lit(0.0), lambda total, i: total + F.element_at(learned, i + 1)) / F.sqrt(F.greatest(F.size("slots"), F.lit(1)))
    scored = split.withColumn("slots", slots).withColumn("score", 1 / (1 + F.exp(-(margin + bias))))
    rule, verdict = ruled(F.col("host"), F.col("path"), rules)
    return scored.select("page_id", "host", "path", rule.alias("rule"), "score", F.coalesce(verdict, F.when(F.col("score") >= 0.5, "block").otherwise("allow")).alias("verdict"))
