"""Operator 3: URL rules and a learned URL verdict.

Rules name a host and the start of a path; the longest rule that fits decides.
URLs without a rule get the verdict of a logistic regression over hashed
character n-grams of host and path. It is trained on the driver from a small
labelled table of URLs (``labelled_urls``) that is part of this module.

Cases: a null URL or one without ``://`` has an empty host and path, no rule,
and the model's verdict on nothing, which is allow; repeated rows give a row each; URLs of any
length are read whole; an empty table gives an empty result; only ``page_id`` and ``url`` are read.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from glyphmill.llm.common import slices

DIMENSIONS = 1 << 17

# The labelled table. Invented addresses of the kinds that filter lists block, and of ordinary sites.
BLOCKED = """
https://www.casino-win.example.com/slots/play https://royal-casino.com/bonus http://casinonights.net/free-spins https://onlinecasino24.example.org/welcome-bonus
https://free-bets.example.net/football https://betting-tips.com/odds/today http://sportsbetting.org/join https://www.bet-now.example.com/live
https://poker-room.com/tables http://videopoker.example.net/play https://texas-poker-online.org/register https://slots-mania.com/jackpot
http://luckyslots.example.org/spin https://megajackpot.net/claim https://roulette-wheel.com/strategy https://lottery-win.example.com/numbers
http://winlottery.org/prize https://cheap-pills.com/order http://pillsonline.example.net/buy-now https://www.cheapviagra.com/discount
http://viagra-shop.org/buy https://pharmacy-deal.example.com/no-prescription https://discountpharmacy.net/meds https://adult-videos.com/watch
http://freeadult.example.org/gallery https://adultchat.net/rooms https://pornhost.com/videos http://free-porn.example.net/hd
https://xxx-movies.org/stream http://xxxpics.com/set/12 https://sex-cams.example.com/live http://livesexchat.net/enter
https://escort-service.com/city http://escorts.example.org/book https://hot-singles.net/near-you http://meetsingles-hot.com/tonight
https://payday-loan.example.com/apply http://paydayloans.org/instant https://quick-cash.net/now http://fastcashloan.com/approve
https://replica-watches.example.net/rolex http://replicabags.com/shop https://warez-world.org/download http://warezforum.example.com/releases
https://crack-download.net/software http://crackedgames.com/full https://keygen-files.org/serial http://keygens.example.net/get
https://torrent-dump.com/movies http://freetorrents.example.org/top https://malware-host.net/setup.exe http://malwaredrop.com/update
https://phishing-login.example.com/verify-account http://bankphish.org/secure/login https://spam-mail.net/bulk http://spamlists.com/buy
https://click-bait.example.org/shocking http://clickbaitnews.net/you-wont-believe https://popup-ads.com/show http://popups.example.net/banner
https://get-rich.org/secret http://getrichquick.com/start https://prize-winner.example.com/claim-prize http://you-won-prizes.net/gift
https://miracle-diet.com/lose-weight http://dietmiracle.example.org/trial https://hack-tool.net/generator http://gamehacks.com/cheats
https://ads-server.example.com/serve http://adserver.net/pixel https://ad-tracker.org/click http://adtracking.example.net/redirect
https://link-farm.com/directory http://linkfarms.org/submit https://crypto-giveaway.example.com/double http://freebitcoins.net/claim
https://adultzone.com/members http://adult-shop.example.net/toys https://adultdating.org/signup https://ads-exchange.com/bid
http://adsnetwork.example.org/tag.js https://www.ads-media.net/banner https://spam-sender.com/smtp http://spambots.net/order
https://spamblaster.example.com/send http://trackerpixel.com/i.gif https://ad-clicks.example.net/out https://linkfarming.com/add-url
"""
ALLOWED = """
https://www.daily-news.example.com/2020/05/story.html https://citynews.org/politics/12 https://morning-paper.net/world/article/7.html https://blog.gardener.example.org/tomatoes
https://travel-blog.com/italy/rome https://docs.example.net/guide/install https://docs.buildtool.org/reference https://wiki.example.com/History_of_printing
https://gamewiki.org/page/start https://library.example.org/catalogue https://citylibrary.net/opening-hours https://www.school.example.com/timetable
https://primaryschool.org/parents https://university.example.net/physics/lectures https://stateuniversity.com/admissions https://science-magazine.org/issues/41
https://openscience.example.com/papers https://research-centre.net/projects https://labresearch.org/publications https://journal-of-biology.com/volume/3
https://medicaljournal.example.org/abstracts https://museum.example.net/exhibitions https://artmuseum.com/visit https://localhistory.org/town
https://history-society.example.com/talks https://musicschool.net/lessons https://folk-music.org/songs https://family-recipes.com/bread
https://recipes.example.org/soup/tomato https://travelguide.net/spain https://rail-travel.com/timetables https://weather.example.com/forecast
https://weatherstation.org/today https://publichealth.example.net/advice https://health-centre.com/appointments https://garden-club.org/roses
https://kitchengarden.example.com/planting https://sports-club.net/fixtures https://localsports.org/results https://theatre.example.org/programme
https://citytheatre.com/tickets https://bookshop.example.net/new https://books-review.org/novels https://maps.example.com/route
https://oldmaps.net/europe https://forum.woodwork.example.org/thread/88 https://parents-forum.com/topic/4 https://help.example.net/faq
https://support.mailtool.com/article/15 https://developer.example.org/api https://developers-hub.net/tutorials https://community-centre.com/events
https://archive.example.com/letters/1890 https://filmarchive.org/collection https://gallery.example.net/paintings https://photogallery.org/landscape
https://college.example.com/courses https://energy-agency.org/reports https://cleanenergy.example.net/solar https://nature-reserve.com/birds
https://naturepark.org/paths https://city-council.example.org/minutes https://oldcity.net/walks https://region-north.com/villages
https://farmers-market.example.com/stalls https://culture-office.org/grants https://language-school.net/german https://languages.example.org/grammar
https://mathematics.example.com/geometry https://physics-today.org/optics https://chemistry.example.net/experiments https://astronomyclub.com/moon
https://bakery.example.org/bread https://carpenter-tools.com/planes https://railwaymodels.net/scale https://knitting.example.com/patterns
https://hiking-trails.org/alps https://sailing.example.net/harbours https://bicycle-repair.com/wheels https://chess-club.example.org/games
https://cathedral.org/organ https://river-watch.net/levels https://weavers.example.com/looms https://pottery.org/glazes
https://thermal-springs.com/baths https://thatchers-guild.example.org/roofs https://thinking-school.net/essays https://thesaurus.example.com/words
https://www.thornton-parish.org/church https://theory-group.example.net/seminars https://therapists-register.org/find https://m.threshing-museum.com/engines
https://transition-town.example.org/meetings https://www.station-house.net/rooms https://inns-of-hereford.com/breakfast https://other-voices.example.net/poems
https://blog.anderson-farm.com/spring https://m.city-tram.example.com/lines https://shore-birds.org/terns https://notebook.example.org/2019/11
https://www.lantern-press.com/titles https://m.rivers-trust.net/otters https://blog.stone-walls.org/dry https://herons.example.com/nests
"""


def labelled_urls() -> list[tuple[str, int]]:
    """The training table; 1 is block."""
    return [(url, 1) for url in BLOCKED.split()] + [(url, 0) for url in ALLOWED.split()]


def parts(url: str | None) -> tuple[str, str]:
    """Host (A-Z in lower case) and path of a URL."""
    if url is None or "://" not in url:
        return "", ""
    rest = url.split("://", 1)[1]
    end = min((i for i in map(rest.find, "/?#") if i >= 0), default=len(rest))
    host, path = rest[:end], rest[end:]
    stop = min((i for i in map(path.find, "?#") if i >= 0), default=len(path))
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in host), path[:stop]


def _slots(texts: list[str], seed: int, low: int, high: int) -> tuple[np.ndarray, np.ndarray]:
    """(row, slot) of the distinct hashed character n-grams of each text."""
    points = [np.frombuffer(t.encode("utf-32-le", "surrogatepass"), "<u4") for t in texts]
    sizes = np.array([len(p) for p in points], np.int64)
    flat = np.concatenate(points).astype(np.uint64) if points else np.zeros(0, np.uint64)
    row, left = np.repeat(np.arange(len(texts)), sizes), np.repeat(np.cumsum(sizes), sizes) - np.arange(len(flat))
    found, h = [], np.full(len(flat), seed, np.uint64)
    for n in range(1, high + 1):
        reach = max(0, len(flat) - n + 1)
        h = h[:reach] * np.uint64(0x100000001B3) + flat[n - 1 :][:reach] + np.uint64(1)
        if n >= low:
            whole = left[:reach] >= n
            mixed = h[whole] * np.uint64(0x9E3779B97F4A7C15)
            found.append(row[:reach][whole] * DIMENSIONS + (mixed >> np.uint64(40)).astype(np.int64) % DIMENSIONS)
    cells = np.unique(np.concatenate(found)) if found else np.zeros(0, np.int64)
    return cells // DIMENSIONS, cells % DIMENSIONS


def features(urls: list[tuple[str, str]], low: int = 3, high: int = 6, path_share: float = 0.25) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hashed character n-grams of hosts and paths, each side with a seed of its own: rows, slots and values.

    Either side has unit length, so a long path doesn't drown a host; the path's is scaled down.
    """
    out = []
    for seed, texts, share in ((1, [f"^{h}$" if h else "" for h, _ in urls], 1.0), (2, [p.lower() for _, p in urls], path_share)):
        rows, slots = _slots(texts, seed, low, high)
        count = np.bincount(rows, minlength=len(urls))
        out.append((rows, slots, share / np.sqrt(np.maximum(1, count))[rows]))
    return tuple(np.concatenate(x) for x in zip(*out))


@dataclass
class LogisticModel:
    weights: np.ndarray
    bias: float

    def probabilities(self, urls: list[tuple[str, str]]) -> np.ndarray:
        """Of block, for (host, path) pairs."""
        rows, slots, values = features(urls)
        return 1 / (1 + np.exp(-(self.bias + np.bincount(rows, self.weights[slots] * values, len(urls)))))


def train(rows: list[tuple[str, int]] | None = None, rounds: int = 400, rate: float = 16.0, decay: float = 1e-4) -> LogisticModel:
    """Full-batch gradient descent on the labelled table, over the slots that occur in it."""
    labelled = labelled_urls() if rows is None else rows
    row, slot, value = features([parts(url) for url, _ in labelled])
    used, at = np.unique(slot, return_inverse=True)
    y = np.array([label for _, label in labelled], float)
    w, bias = np.zeros(used.size), 0.0
    for _ in range(rounds):
        error = 1 / (1 + np.exp(-(np.bincount(row, w[at] * value, len(y)) + bias))) - y
        w -= rate * (np.bincount(at, error[row] * value, used.size) / len(y) + decay * w)
        bias -= rate / 8 * float(error.mean())
    weights = np.zeros(DIMENSIONS)
    weights[used] = w
    return LogisticModel(weights, bias)


def after_scheme(url: str) -> Column:
    """What follows the first ``://`` of a column; null where there is none."""
    c = F.col(url)
    return F.when(F.instr(c, "://") > 0, F.substring(c, F.instr(c, "://") + 3, F.length(c)))


def host_column(url: str) -> Column:
    host = F.regexp_extract(after_scheme(url), "^[^/?#]*", 0)
    return F.coalesce(F.translate(host, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"), F.lit(""))


def path_column(url: str) -> Column:
    return F.coalesce(F.regexp_extract(after_scheme(url), "^[^/?#]*([^?#]*)", 1), F.lit(""))


def rule_column(rules: list[tuple[str, str]], host: Column, path: Column) -> Column:
    """The longest rule (text like ``net/``) that fits; equally long ones by text."""
    out = F.lit(None).cast("string")
    for rule, _ in sorted(rules, key=lambda r: (len(r[0]), r[0])):
        name, _, start = rule.partition("/")
        fits = ((host == name) | host.endswith("." + name)) & path.startswith("/" + start)
        out = F.when(fits, F.lit(rule)).otherwise(out)
    return out


def judge_urls(pages: DataFrame, rules: list[tuple[str, str]], model: LogisticModel | None = None, threshold: float = 0.5) -> DataFrame:
    """page_id, host, path, rule, verdict and the model's probability of block.

    Rules number as a configuration does: they are one expression. Probabilities are computed over Arrow batches.
    """
    held = pages.sparkSession.sparkContext.broadcast(model or train())
    df = pages.select("page_id", "url").withColumns({"host": host_column("url"), "path": path_column("url")})
    df = df.withColumn("rule", rule_column(rules, F.col("host"), F.col("path"))).select("page_id", "host", "path", "rule")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = held.value
        for rows in slices(batches, 4096):
            p = m.probabilities(list(zip(rows.column(1).to_pylist(), rows.column(2).to_pylist())))
            yield pa.RecordBatch.from_arrays([*rows.columns, pa.array(p, pa.float64())], names=["page_id", "host", "path", "rule", "p_block"])

    kind = pages.schema["page_id"].dataType.simpleString()
    scored = df.mapInArrow(run, f"page_id {kind}, host string, path string, rule string, p_block double")
    said = F.lit(None).cast("string")
    for rule, verdict in rules:
        said = F.when(F.col("rule") == rule, F.lit(verdict)).otherwise(said)
    return scored.withColumn("verdict", F.coalesce(said, F.when(F.col("p_block") >= threshold, "block").otherwise("allow"))).select("page_id", "host", "path", "rule", "verdict", "p_block")
