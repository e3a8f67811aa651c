"""Operator 8: URL filter by host and path rules, then logistic regression.

Hosts and paths that no rule fits are judged by a logistic regression on hashed character
n-grams of host and path, fitted on the labelled table below when the query is built. The
rules and the host and path columns are built-in expressions; the model scores Arrow batches.

Defined results: a null url, or one without ``://``, has an empty host and path and no rule,
and gets the model's verdict on the empty text; repeated urls repeat their verdict; input
columns named like an output give way.
"""

from __future__ import annotations

import re
import zlib

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import fewer

OUTPUTS = ("host", "path", "rule", "verdict", "score")

#: (rule, verdict); a rule is a host and the path prefix after it.
RULES = [("net/", "block"), ("example.net/en/", "allow"), ("example.com/de/", "block"), ("org/fr/", "allow")]

# The labelled table: invented urls to block (gambling, pills, adult, loans, cracks, ads, prizes, copies) and to allow.
BLOCKED = """
http://casino-royal-play.com/slots http://www.bestcasino777.net/bonus/500 http://online-casino-hub.org/free-spins http://mega-slots-casino.info/play http://casinospin.club/jackpot/3
http://poker-stars-win.biz/tables http://livepoker-bonus.com/join http://m.poker-cash.net/deposit/20 http://bet365wins.info/odds http://sportsbet-odds.com/live/88
http://free-betting-tips.org/today http://betwin-bonus.net/signup http://www.jackpot-lottery-win.com/claim http://lottery-prize-winner.org/claim/9 http://spin-slots-free.com/bonus
http://cheap-viagra-pills.com/buy http://buy-cialis-online.net/order/2 http://discount-pills-rx.org/shop http://pills-no-prescription.com/cart http://rx-meds-cheap.info/buy/7
http://www.canadian-pills-shop.biz/viagra http://diet-pills-fast.com/order http://weightloss-pills.net/buy-now http://cheapmeds24.com/pharmacy/discount http://buy-xanax-meds.org/cheap
http://xxx-adult-video.com/watch http://free-adult-cams.net/live/4 http://hot-adult-dating.org/join http://adult-xxx-tube.info/video/31 http://sexy-cams-live.com/girls
http://www.adult-hookup-dating.net/signup http://m.xxxvideos-free.org/watch/12 http://sex-dating-tonight.com/meet http://adultchat-cams.biz/free http://hotgirls-cam.club/live
http://payday-loans-fast.com/apply http://cheap-loan-today.net/apply/3 http://quick-cash-loans.org/money http://no-credit-loans.info/cash-now http://easymoney-loan.biz/apply
http://make-money-fast.com/rich http://work-home-cash.net/earn/900 http://earn-free-money.org/join http://get-rich-crypto.info/invest http://bitcoin-doubler-free.com/deposit
http://free-iphone-prize.com/claim http://win-free-gift.net/prize/1 http://www.prize-winner-gift.org/claim http://freegiftcards-win.info/survey http://survey-reward-win.com/gift
http://crack-keygen-download.com/serial http://warez-free-crack.net/download/5 http://torrent-cracked-games.org/keygen http://serial-keygen-crack.info/full http://free-warez-download.biz/crack
http://click-ads-tracker.com/popup http://adserver-banner.net/click/77 http://track-popunder-ads.org/r http://popads-clicks.info/banner http://ad-click-redirect.biz/track/6
http://cheap-replica-watches.com/buy http://replica-rolex-shop.net/discount http://fake-handbags-cheap.org/order/8 http://cheap-replica-bags.info/sale http://discount-watches-replica.biz/buy
http://seo-backlinks-cheap.com/buy http://spam-mailer-bulk.net/order http://bulk-email-spam.org/list/4 http://cheap-traffic-clicks.info/buy http://spamlinks-seo.biz/backlinks
http://hot-deals-cheap.club/buy-now http://free-download-win.com/click http://www.spin-win-cash.org/bonus http://m.cheap-pills-meds.com/buy http://blog.casino-bonus-spins.net/free
"""
ALLOWED = """
http://citylibrary.org/catalogue http://www.northlibrary.net/opening-hours http://library-archive.org/manuscripts/12 http://schoollibrary.com/readers http://universitylibrary.org/theses/2019
http://hillschool.org/timetable http://www.riverside-school.com/teachers http://primaryschool.net/lessons/4 http://university-physics.org/lectures http://stateuniversity.com/research/papers/7
http://college-history.org/courses http://www.mathematics-institute.net/seminar/3 http://science-journal.org/articles/55 http://journalofbiology.com/volume/9 http://chemistry-notes.net/elements
http://naturalhistorymuseum.org/exhibits http://museum-of-art.com/paintings/8 http://www.railwaymuseum.net/visit http://gallery-modern.org/sculpture http://townmuseum.com/history/1900
http://dailynews.com/politics/2021 http://www.eveningpost.org/world http://localnews-valley.net/stories/6 http://morning-herald.com/opinion http://news-agency.org/reports/41
http://weatherforecast.com/tomorrow http://m.weather-station.org/rain/3 http://climate-data.net/tables http://mountain-weather.org/snow http://oceancurrents.net/maps/2
http://gardening-notes.org/roses http://blog.vegetablegarden.com/tomatoes/5 http://birdwatching.net/species/77 http://www.forest-trees.org/oak http://wildflowers.com/meadow
http://recipes-kitchen.com/bread http://blog.soupandstew.org/lentils/2 http://bakinghome.net/cakes http://www.slowcooking.com/beans/9 http://cookbook-classics.org/sauces
http://docs.opensource.org/manual http://developer-guide.com/python/tutorial http://wiki.programming.net/algorithms/18 http://www.linuxhandbook.org/commands http://database-theory.com/joins/4
http://travel-diary.org/mountains http://blog.walkingtours.com/castles/3 http://www.islandferries.net/timetable http://railtimetable.org/stations/66 http://cityguide.com/bridges
http://hospital-trust.org/departments http://www.nursing-handbook.net/wards http://health-research.org/studies/14 http://medicine-journal.com/trials http://dentistsociety.org/members
http://parliament.org/debates/30 http://www.townhall.net/council http://lawreports.org/cases/1987 http://courts-archive.com/judgments http://publicrecords.org/census/5
http://orchestra.org/concerts http://www.chambermusic.net/quartets/2 http://folk-songs.org/ballads http://theatre-company.com/plays/11 http://filmsociety.org/archive
http://chessclub.org/openings/7 http://www.rowingclub.net/regatta http://football-league.com/results/33 http://cyclingroutes.org/hills http://athletics-federation.org/records
http://poetry-archive.org/sonnets http://www.novelists.net/chapters/6 http://philosophy-pages.org/ethics http://languagelearning.com/grammar/4 http://dictionary-project.org/words
"""
BITS, LEAST_N, MOST_N = 15, 3, 5
#: The length of the path's part of the features; the host's is 1.
PATH_WEIGHT = 0.2
_LOWER = {c: c + 32 for c in range(65, 91)}


def host_of(url: Column) -> Column:
    found = F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1)
    return F.coalesce(F.translate(found, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"), F.lit(""))


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def longest_rule(host: Column, path: Column, rules=RULES) -> Column:
    """The longest rule that fits, or null."""
    out = F.lit(None).cast("string")
    for rule, _ in sorted(rules, key=lambda r: (len(r[0]), r[0])):
        own, _, rest = rule.partition("/")
        fits = ((host == own) | host.endswith("." + own)) & path.startswith("/" + rest)
        out = F.when(fits, F.lit(rule)).otherwise(out)
    return out


def _hashed(mark: str, part: str) -> np.ndarray:
    """The hashed n-grams of a part, its ends marked; runs of digits are alike."""
    part = f"^{re.sub('[0-9]+', '0', part)}$"
    out = {zlib.crc32(f"{mark}{part[i : i + n]}".encode("utf-8", "replace")) >> (32 - BITS) for n in range(LEAST_N, MOST_N + 1) for i in range(len(part) - n + 1)}
    return np.fromiter(sorted(out), np.int64, len(out))


def features(host: str, path: str) -> list[tuple[np.ndarray, float]]:
    """(n-grams, value of each) of host and path: each part has a length of its own, so that a longer path takes nothing from the host."""
    out = []
    for mark, part, weight in (("h", host, 1.0), ("p", path, PATH_WEIGHT)):
        hits = _hashed(mark, part)
        out.append((hits, weight / np.sqrt(max(1, len(hits)))))
    return out


def parts_of(url: str) -> tuple[str, str]:
    """Host and path as ``host_of`` and ``path_of`` cut them."""
    found = re.search(r"://([^/?#]*)([^?#]*)", url)
    return (found[1].translate(_LOWER), found[2]) if found else ("", "")


def fitted(blocked: list[str], allowed: list[str], rounds: int = 400, rate: float = 4.0, decay: float = 1e-3) -> np.ndarray:
    """Weights by plain gradient descent; the last one is the intercept."""
    rows = [(url, 1.0) for url in blocked] + [(url, 0.0) for url in allowed]
    x = np.zeros((len(rows), 2**BITS + 1))
    for r, (url, _) in enumerate(rows):
        for hits, value in features(*parts_of(url)):
            x[r, hits] += value
        x[r, -1] = 1
    y, w = np.array([v for _, v in rows]), np.zeros(x.shape[1])
    used = np.flatnonzero(x.any(0))
    x, v = x[:, used], w[used]
    for _ in range(rounds):
        v -= rate * (x.T @ (1 / (1 + np.exp(-x @ v)) - y) / len(y) + decay * v)
    w[used] = v
    return w


def url_filter(df: DataFrame, url: str = "url", rules=RULES, blocked: str = BLOCKED, allowed: str = ALLOWED) -> DataFrame:
    """``df`` with ``host``, ``path``, the ``rule`` that fits, ``score`` and ``verdict``."""
    weights = fitted(blocked.split(), allowed.split())

    @F.pandas_udf("double")
    def score(hosts: pd.Series, paths: pd.Series) -> pd.Series:
        known: dict[tuple[str, str], float] = {}
        out = []
        for key in zip(hosts, paths, strict=True):
            if key not in known:
                known[key] = float(sum(weights[hits].sum() * value for hits, value in features(*key)) + weights[-1])
            out.append(1 / (1 + np.exp(-known[key])))
        return pd.Series(out, dtype="float64")

    rest = fewer(df, *OUTPUTS)
    at = F.col(f"`{url}`")
    out = rest.select("*", host_of(at).alias("host"), path_of(at).alias("path"))
    out = out.select("*", longest_rule(F.col("host"), F.col("path"), rules).alias("rule"), score("host", "path").alias("score"))
    by_rule = F.lit(None).cast("string")
    for rule, verdict in rules:
        by_rule = F.when(F.col("rule") == rule, F.lit(verdict)).otherwise(by_rule)
    return out.select("*", F.coalesce(by_rule, F.when(F.col("score") >= 0.5, F.lit("block")).otherwise(F.lit("allow"))).alias("verdict"))
