r"""URL filter: host and path rules first, then logistic regression on hashed character n-grams.

A rule is (host, path, verdict). It fits the host itself and its subdomains if the url's path starts with
the rule's; of several the longest (host and path together) wins. Urls that no rule fits are judged by a
model over character 3- to 5-grams of the host's labels and of the path, hashed to ``BUCKETS``; it is
trained on the driver from ``labelled()``, a small table in this module, or from one that the caller gives.

Rows: a null url or one without ``://`` has an empty host and path; no rule fits and it is allowed, as there
is nothing to judge. Repeated rows are judged alike. Other columns are not read.
"""

from __future__ import annotations

import re
import string
import zlib
from collections.abc import Sequence
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from terravane.llm import logistic
from terravane.runtime import ship

BUCKETS = 1 << 13
# (host, path, verdict)
RULES = [
    ("com", "/en/", "block"),
    ("example.com", "/en/7", "allow"),
    ("net", "/de/", "allow"),
    ("example.net", "/de/8", "block"),
    ("org", "/es/", "block"),
]
# Labelled host names, written from general knowledge of spam, gambling, pharmacy, adult, advertising and malware hosts on
# one side and of ordinary sites on the other; none is taken from a table of pages.
BAD_NAMES = (
    "casino casinos-online online-casino royal-casino casino-bonus mega-casino slots slots-bonus free-slots slot-machines lucky-slot poker poker-room "
    "video-poker texas-poker jackpot mega-jackpot jackpot-city roulette live-roulette blackjack-online bingo-cash gambling gambling-tips betting betting-odds "
    "sports-betting bets-online best-betting bookmaker-bonus sportsbook win-cash win-prizes winbig instant-win lottery-winner lotto-results-win "
    "pills diet-pills pills-shop buy-pills-now pharmacy-cheap cheap-pharmacy online-pharmacy-rx viagra generic-viagra cialis buy-cialis xanax-online meds-cheap "
    "cheapmeds no-prescription weight-loss-fast miracle-cure steroids-shop adult adults-only adult-video adult-dating adult-chat porn porno-tube free-porn "
    "xxx xxx-tube hot-xxx sex sex-chat sexcams live-sex escort escorts-city camgirls webcam-girls hookup-tonight milf-tube nude-pics erotic-video "
    "ads adserver ad-server ads-network adclick click-ads popads popunder banner-ads ad-exchange ads-delivery tracking tracker ad-tracker track-click "
    "click-track pixel-tracker clickbank-offers affiliate-clicks spam spammer spam-mail mail-spam spamlinks link-exchange buy-links backlinks-cheap "
    "link-spam seo-backlinks buy-followers buy-likes free-followers free-gift free-money free-iphone free-spins free-vbucks freecash freebies-now cheap-loans payday payday-loans "
    "cash-loans quick-loans bad-credit-loans debt-relief-now forex-robot forex-signals bitcoin-doubler crypto-giveaway get-rich-quick make-money-fast "
    "work-from-home-cash replica replica-watches fake-rolex cheap-rolex cheap-handbags cheap-viagra cheap-cigarettes warez warez-download keygen serial-keygen "
    "crack-software cracked-games torrent-movies free-movies-hd malware malware-download virus-alert win-antivirus pc-cleaner-free toolbar-install phishing "
    "login-verify account-verify paypal-verify secure-login-update verify-wallet downloader-free hot-deals-now click-here"
).split()
GOOD_NAMES = (
    "news daily-news morning-post evening-times weekly-review gazette chronicle herald tribune observer journal bulletin press-office radio public-radio "
    "television weather weather-report climate forecast library city-library national-library archive archives museum art-museum gallery theatre opera "
    "orchestra music-school concert-hall university college high-school primary-school academy institute faculty research research-institute science "
    "science-today physics chemistry biology mathematics astronomy geology history history-society archaeology philosophy language dictionary encyclopedia "
    "wiki reference atlas maps street-maps geography travel travel-guide tourism hotel hostel railway trains bus-timetable airport harbour shipping "
    "bicycle cycling hiking mountain alpine-club river lake forest garden gardening gardens allotment farming farm orchard dairy bakery bread recipes cooking "
    "kitchen restaurant cafe coffee tea wine brewery cheese vegetables market grocery bookshop bookstore books reading poetry writers publisher printing "
    "stationery furniture carpentry woodwork pottery knitting sewing textile fashion shoes clothing jewellery photography camera cinema film festival "
    "football football-club cricket rugby tennis hockey swimming athletics chess chess-club boardgames puzzle sport sports-club stadium gymnastics "
    "health hospital clinic doctor dentist nursing medicine pharmacology nutrition fitness family parents children kindergarten charity volunteer community "
    "parish church temple council town-hall parliament government ministry court law legal-advice police fire-brigade post-office statistics census "
    "economy economics finance bank savings insurance accounting business company engineering construction architecture housing property energy "
    "electricity solar water recycling environment wildlife birds bird-watching animals veterinary horses dogs cats aquarium zoo fishing sailing "
    "software programming developer opensource documentation tutorial computer hardware electronics robotics network internet security-research data "
    "open-data database forum diary notes letters address calendar events jobs careers training course lessons exam student teacher alumni "
    "universität zeitung nachrichten bibliothek schule verein wetter stadt gemeinde garten küche rezepte reise wandern gesundheit wissenschaft geschichte "
    "journal-local actualités bibliothèque école musée jardin cuisine recettes voyage santé histoire mairie noticias biblioteca escuela museo jardín "
    "cocina recetas viajes salud historia ciudad ayuntamiento tiempo north south east west northern southern eastern western hill valley green river-side "
    "brown smith johnson miller taylor martin thompson anderson henderson robertson harrison richardson patterson sutherland northumberland leicester "
    "winchester manchester rochester dorchester oxford cambridge stratford edinburgh aberdeen inverness wellington washington winter winners-school window-maker "
    "bethany bettina alphabet diabetes-care tibet spillway pillar caterpillar adulthood-studies address-book roadside shadow ladder padlock trackless railtrack-history "
    "race-track tractor stretcher essex sussex middlesex wessex linking-ring linkage clickable hollow freedom freeman freeway cheapside cheapstow"
).split()
_PATHS = ("", "/en/17", "/de/a/204.html", "/fr/88/", "/es/9?page=2", "/news/2023/05/item", "/index.html", "/archive/3/")
_BAD_WORDS = ("casino", "pills", "xxx", "porn", "betting", "spam", "viagra", "jackpot", "poker", "payday")


def rows_of(names: Sequence[str], label: int) -> list[tuple[str, str, int]]:
    """(host, path, label) rows: each name under several domains and paths."""
    tops, subs = ("com", "net", "org", "info", "example.com", "example.net", "example.org"), ("", "www.", "blog.", "m.")
    rows = []
    for i, n in enumerate(names):
        for k in range(3):
            rows.append((f"{subs[(i + k) % 4]}{n}.{tops[(i + 2 * k) % 7]}", _PATHS[(i + 3 * k) % 8].split("?")[0], label))
    return rows


@lru_cache(maxsize=1)
def labelled() -> tuple[tuple[str, str, int], ...]:
    """The labelled url table: (host, path, 1 for block)."""
    rows = rows_of(BAD_NAMES, 1) + rows_of(GOOD_NAMES, 0)
    rows += [(f"{GOOD_NAMES[7 * k]}.example.org", f"/{word}/offer", 1) for k, word in enumerate(_BAD_WORDS)]
    return tuple(rows)


def features(host: str, path: str) -> list[int]:
    found = set()
    for part in re.split(r"[.\-_:@]+", host):
        p = f"^{part}$"
        found.update(f"h{p[i : i + n]}" for n in (3, 4, 5) for i in range(len(p) - n + 1))
    for part in re.split(r"[/.\-_]+", path.lower()):
        p = f"^{part}$"
        found.update(f"p{p[i : i + n]}" for n in (3, 4, 5) for i in range(len(p) - n + 1) if len(part) > 2)
    return sorted({zlib.crc32(g.encode()) % BUCKETS for g in found})


def train(rows: Sequence[tuple[str, str, int]] | None = None) -> tuple[np.ndarray, float]:
    rows = labelled() if rows is None else rows
    return logistic.fit([features(h, p) for h, p, _ in rows], [y for *_, y in rows], BUCKETS)


_default_model = lru_cache(maxsize=1)(train)


def host_of(url: Column) -> Column:
    host = F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)\A.*?://([^/?#]*)", 1)
    return F.translate(host, string.ascii_uppercase, string.ascii_lowercase)


def path_of(url: Column) -> Column:
    return F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)\A.*?://[^/?#]*([^?#]*)", 1)


def judge(pages: DataFrame, rules=None, model=None, block_at: float = 0.5) -> DataFrame:
    """(page_id, host, path, rule, verdict, score) of every row; score is the model's, also where a rule decides."""
    ship(pages.sparkSession)
    rules = RULES if rules is None else rules
    weights, bias = model or _default_model()
    rows = pages.select("page_id", host_of(F.col("url")).alias("host"), path_of(F.col("url")).alias("path"))

    def run(batches):
        for b in batches:
            z = [
                logistic.probability(float(weights[features(h, p)].sum()) + bias) if h else 0.0
                for h, p in zip(b.column(1).to_pylist(), b.column(2).to_pylist())
            ]
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(z, pa.float64())], [*b.schema.names, "score"])

    kind = pages.schema["page_id"].dataType.simpleString()
    scored = rows.mapInArrow(run, f"page_id {kind}, host string, path string, score double")
    rule, verdict = F.lit(None).cast("string"), F.when(F.col("score") >= block_at, "block").otherwise("allow")
    for host, path, says in sorted(rules, key=lambda r: len(r[0] + r[1])):  # the longest is asked first
        fits = ((F.col("host") == host) | F.col("host").endswith(f".{host}")) & F.col("path").startswith(path)
        rule, verdict = F.when(fits, host + path).otherwise(rule), F.when(fits, says).otherwise(verdict)
    return scored.select("page_id", "host", "path", rule.alias("rule"), verdict.alias("verdict"), "score")
