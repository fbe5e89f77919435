"""URL filters: stated rules, and for other URLs a logistic regression on hashed character n-grams.

The host is what stands after the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z lower-cased;
the path is what follows up to ``?``, ``#`` or the end. A rule names a host and a path; it fits URLs
of that host and of its subdomains whose path starts with the rule's, and the longest rule wins.

Where no rule fits, n-grams of the host and of the path (each marked as such) are hashed into
``DIMENSIONS`` features, and a logistic regression decides. It is trained on a small labelled URL
table, a parameter; the default one is the hand-written table below, and ``cross_error`` tells how
often the regression errs on parts of a table that it has not seen.

A null URL, or one without ``://``, has an empty host and path: no rule fits and the regression's
bias decides. Rows that repeat, and rows with a null id, are judged as rows of their own.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import table

# The rules, as verdict and host with path.
RULES = (("allow", "org/"), ("block", "example.org/es/"), ("block", "example.org/en/1"), ("allow", "com/fr/"), ("block", "com/de/"))

DIMENSIONS = 1 << 14
GRAMS = (3, 4, 5)
RIDGE = 3e-4

# The labelled URL table, written by hand for this module. Allowed URLs are of kinds that
# hold prose: reference works, schools, research, news, public bodies, hobbies, small firms. Blocked
# ones are of kinds that hold none worth reading: gambling, adult, drug and loan spam, pirated files, fraud.
ALLOWED = """
http://www.riverside-library.com/catalogue/local-history  https://plants.kew-gardens.org/species/quercus-robur
https://docs.numericpy.dev/stable/reference/arrays.html  http://oldtownmuseum.net/exhibitions/bronze-age
https://blog.mountainweather.ch/2021/03/avalanche-notes  https://encyclopedia.openknowledge.com/wiki/Photosynthesis
http://www.cityuniversity.edu/physics/lectures/optics-4  https://news.harbourtimes.co.uk/politics/council-budget
https://www.grandmaskitchen.info/recipes/apple-strudel  http://travel.slowtrains.eu/routes/lisbon-to-porto
https://www.astronomyclub.com/observing/moon-phases  https://health.gov.example.org/guidance/measles-vaccine
http://poetry.archive.si.edu/poems/autumn-evening  https://forum.woodworkers.net/thread/dovetail-joints
https://www.classicalradio.fm/composers/schubert  http://journals.biology-letters.com/articles/coral-reefs
https://primaryschool-hill.sch.uk/parents/term-dates  https://villagebakery.fr/notre-histoire
http://developer.webstandards.info/css/grid-layout  https://courtreports.gov.au/judgments/2019/14
https://philosophy.stanfordhall.edu/entries/kant-ethics  http://birdwatch.nl/waarnemingen/ooievaar
https://www.chesshistory.com/games/immortal-game  https://maps.geosurvey.de/karten/alpenvorland
http://www.theatrereviews.org/plays/the-seagull  https://cyclingdiary.net/tours/danube-path
https://support.mailclient.com/en/import-contacts  http://marinebiology.es/articulos/ballenas
https://www.parliament-records.uk/debates/1994/education  https://gardening.suburbanplots.info/tips/compost-heap
http://www.localpaper.com/sport/football-results  https://watercolour-lessons.org/brushes/how-to-choose
https://stories.fireside.blog/the-lighthouse-keeper  http://railwaymuseum.cz/lokomotivy/parni
https://lab.neuroscience.edu/publications/memory-sleep  https://knittingcircle.ie/patterns/aran-sweater
http://www.oceanography.no/data/tide-tables  https://grammar.learnitalian.it/verbi/congiuntivo
https://www.townhall-meeting.gov/minutes/2020-06  http://beekeepers.org.nz/seasons/spring-feeding
https://www.economicsweekly.net/markets/interest-rates-explained  https://climbinggym.at/kurse/anfaenger
http://archive.folksongs.ca/songs/the-fishermans-wife  https://medievalhistory.com/castles/carcassonne
https://bugs.textedit.dev/issues/2231  http://filmsociety.info/essays/silent-cinema
https://www.botanicgarden.pt/plantas/orquideas  https://sciencefair.school/projects/volcano
http://www.pediatrics-journal.com/content/asthma-review  https://familytree.org/guides/parish-registers
https://www.architecturetoday.dk/projects/harbour-bath  http://coffeeroasters.coop/brewing/pour-over
https://handbook.sailingschool.gr/knots/bowline  https://nationalarchive.gov.pl/dokumenty/1863
http://www.veterinaryadvice.net/dogs/ear-infections  https://linguistics-review.com/volumes/12/tone
https://www.opensourcecad.info/manual/sketcher  http://communitychoir.com/concerts/winter
https://www.mathpuzzles.org/geometry/tangent-circles  https://charityshop.org.uk/volunteer
http://www.hikingnorway.net/trails/besseggen  https://bookreviews.com/novels/middlemarch
https://www.photographynotes.info/lenses/depth-of-field  http://agriculture.gov.in/crops/millet
https://www.historyofmedicine.com/letters/jenner  https://localhospital.nhs.uk/departments/radiology
http://www.jazzarchive.org/interviews/1961  https://riverpollution.net/reports/nitrates
https://www.kidsastronomy.com/planets/saturn  http://museumofletters.se/brev/1890
https://www.teachersroom.info/lesson-plans/fractions  https://ancientcoins.com/rome/denarius
http://www.savingsadvice.org/pensions/basics  https://constitution-text.net/articles/five
https://www.gamedesignessays.com/boardgames/balance  http://nutritionfacts.school/vitamins/b12
https://www.weatherstation.ee/arhiiv/2018  https://fairytales.dk/eventyr/grimme-aelling
http://www.publictransport.city/timetables/line-7  https://cookingwithherbs.info/basil/pesto
https://www.legaladvicecentre.com/tenants/deposits  http://sculpturepark.be/kunstenaars/rodin
https://www.nursingstudies.edu/modules/anatomy  https://geologyfieldtrips.org/cliffs/jurassic
http://www.mountain-library.net/reading/poems  https://school-garden.com/science/plants
https://www.historyofmusic.info/articles/baroque  http://village-museum.com/guide
https://www.weather-science.org/research/climate  https://cookingschool.net/lessons/bread
http://www.travel-journal.com/notes/rome  https://health-research.info/articles/sleep
https://www.nature-photography.com/birds  http://townlibrary.org/books
https://www.physics-lectures.net/notes/waves  https://art-history.com/essays/monet
http://www.gardenplants.info/roses  https://localnews-archive.com/2015/elections
https://www.software-manual.org/reference/install  http://musicteacher.net/piano/scales
""".split()
BLOCKED = """
http://www.lucky-jackpot-casino777.com/bonus/signup  https://cheap-pills-online-rx.net/buy/viagra-no-prescription
https://www.xxx-hotgirls-cams.org/live/adult-show  http://free-slots-spin-win.com/play/now
https://www.payday-loan-fast-cash.info/apply/bad-credit-ok  https://replica-watches-outlet.shop/rolex-cheap
http://www.download-cracked-software.to/keygen/serial  https://sexdating-local-milfs.com/join/free
https://www.bet-now-sportsbook.bet/odds/free-bets  http://secure-login-bank-verify.net/account/update
https://www.poker-online-realmoney.org/deposit/bonus  https://buy-cialis-levitra-discount.com/order
http://www.torrent-movies-free-hd.to/watch/full  https://earn-money-from-home-fast.info/click-here
https://www.adult-porn-tube-videos.com/xxx/hardcore  http://seo-backlinks-linkfarm.net/buy/links
https://www.crypto-double-your-bitcoin.org/invest/guaranteed  https://casino-roulette-blackjack.com/freespins
http://www.nude-escort-girls.info/city/booking  https://weightloss-miracle-pill.com/diet/order-now
https://www.betting-tips-sure-win.net/fixed-matches  http://prize-winner-claim-iphone.club/you-won
https://www.viagra-cheap-generic.ru/shop/pharmacy  https://spam-blaster-bulk-email.org/lists/buy
http://www.hot-xxx-webcam-sex.com/girls/online  https://loans-no-credit-check.info/instant/approval
https://www.slots-casino-mega-bonus.club/jackpot  http://warez-crack-patch-keys.com/download/setup.exe
https://www.fake-designer-handbags-sale.cn/louis-cheap  https://free-money-giveaway-win.xyz/claim/prize
http://www.gambling-bets-winbig.net/roulette/live  https://malware-codec-update.org/flash/install.exe
https://www.adultfriend-hookup-tonight.com/signup  http://onlinepharmacy-cheapmeds.su/tramadol/xanax
https://www.forex-robot-profit-daily.info/signals/vip  https://article-spinner-content-farm.com/auto/generate
http://www.bingo-poker-slots.win/play/bonus-code  https://erotic-sex-stories-xxx.net/adult/incest
https://www.password-reset-paypa1.org/verify/login.php  http://instant-cash-loans-today.com/payday
https://www.cheap-cigarettes-tax-free.info/buy/carton  https://hacked-accounts-premium-free.xyz/netflix/list
http://www.pornhd-free-sex-clips.com/xxx/teen  https://clickbait-farm-ads.net/you-wont-believe
https://www.megacasino-vip-bets.org/register/freebonus  http://doorway-page-keyword-stuffing.com/cheap/cheap
https://www.steroids-for-sale-online.info/buy/anabolic  https://get-rich-quick-system.com/secret/millionaire
http://www.camgirls-nude-chat.net/xxx/private  https://apk-mod-unlimited-coins-hack.org/download/free
https://www.penis-enlargement-pills.com/order/cheap  http://lottery-winner-notification.info/claim/million
https://www.betwin-sports-casino.top/live/odds  https://fake-antivirus-warning.xyz/scan/infected.exe
http://www.escorts-adult-classifieds.com/xxx/listing  https://buy-followers-likes-cheap.net/order/instagram
https://www.spin-to-win-slots.bet/free/coins  http://binary-options-winning-bot.org/profit
https://www.sexshop-adult-toys-discount.com/xxx/sale  https://pills-weightloss-cheap-rx.info/phentermine
http://www.online-casino-no-deposit.win/bonus/free-spins  https://phishing-apple-id-locked.com/signin/confirm
https://www.hardcore-porn-xxx-movies.net/free/download  http://loan-shark-quick-approval.org/bad-credit
https://www.replica-sneakers-cheap.ru/buy/outlet  https://spam-comments-auto-poster.com/buy/software
http://www.winbets-jackpot-poker.club/signup/bonus  https://free-gift-card-generator.xyz/survey/claim
https://www.hot-singles-near-you.info/adult/dating  http://illegal-streaming-free-tv.to/watch/live
https://www.adult-xxx-comics.com/porn/free  https://autoblog-scraped-content.net/spam/feed
http://www.cheap-viagra-casino.org/deal/now  https://pump-and-dump-coins.com/signals/moon
https://www.sportsbetting-free-tips.win/sure/odds  http://keylogger-spyware-download.info/setup.exe
https://www.jackpot-city-slots-casino.bet/welcome  https://miracle-cure-cancer-pill.com/buy/now
http://www.casino-bets-win.net/free/spins  https://adult-xxx-free-porn.org/girls
https://www.cheap-pills-pharmacy-sale.com/rx  http://spam-links-farm.info/buy/backlinks
https://www.free-casino-slots.com/jackpot  https://poker-betting-bonus.net/bets
http://www.xxx-adult-cams.org/nude  https://pharmacy-pills-discount.com/cheap
https://www.win-free-prize.info/claim  http://payday-cash-loans-cheap.com/apply
https://www.sex-porn-girls.net/xxx  https://replica-bags-cheap-sale.org/buy
http://www.viagra-pills-online.com/order  https://download-free-cracks-warez.info/keygen
https://www.bitcoin-profit-win.com/invest  http://fake-login-verify-account.net/secure
""".split()


def host(url: Column | str) -> Column:
    return F.translate(F.regexp_extract(url, r"^(?s:.*?)://([^/?#]*)", 1), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def path(url: Column | str) -> Column:
    return F.regexp_extract(url, r"^(?s:.*?)://[^/?#]*([^?#]*)", 1)


def rule(host: Column, path: Column, rules: Sequence[tuple[str, str]] = RULES) -> Column:
    """The longest rule that fits, with its verdict; null if none does."""
    found = F.lit(None).cast("struct<rule:string,verdict:string>")
    for verdict, text in sorted(rules, key=lambda r: len(r[1])):
        of_host, slash, of_path = text.partition("/")
        fits = ((host == of_host) | F.endswith(host, F.lit("." + of_host))) & F.startswith(path, F.lit(slash + of_path))
        found = F.when(fits, F.struct(F.lit(text).alias("rule"), F.lit(verdict).alias("verdict"))).otherwise(found)
    return found


def grams(host: str, path: str) -> list[int]:
    """The features of a URL: distinct places of its n-grams."""
    found = set()
    host = host.removeprefix("www.")
    for mark, text in (("h", f"^{host}$" if host else ""), ("p", f"^{path}$" if path else "")):
        for n in GRAMS:
            found.update(zlib.crc32(f"{mark}{text[i : i + n]}".encode()) % DIMENSIONS for i in range(len(text) - n + 1))
    return sorted(found)


def train(labelled: Sequence[tuple[str, str, int]]) -> tuple[np.ndarray, float]:
    """Weights and bias from (host, path, 1 if blocked else 0)."""
    rows = [grams(h, p) for h, p, _ in labelled]
    places = {g: i for i, g in enumerate(sorted({g for r in rows for g in r}))}
    x = np.zeros((len(rows), len(places)))
    for i, r in enumerate(rows):
        x[i, [places[g] for g in r]] = 1 / np.sqrt(len(r))
    # gradient steps on one number a URL: the weights stay sums of the URLs' features
    products, y, a, bias = x @ x.T, np.array([k for _, _, k in labelled], float), np.zeros(len(rows)), 0.0
    for _ in range(2000):
        wrong = (1 / (1 + np.exp(-products @ a - bias)) - y) / len(y)
        a, bias = a - 0.5 * (wrong + RIDGE * a), bias - 0.5 * wrong.sum()
    weights = np.zeros(DIMENSIONS)
    weights[list(places)] = x.T @ a
    return weights, float(bias)


def default_table() -> list[tuple[str, str, int]]:
    """The hand-written table as (host, path, 1 if blocked else 0)."""
    parts = [(url.partition("://")[2].partition("/"), k) for k, urls in ((0, ALLOWED), (1, BLOCKED)) for url in urls]
    return [(of_host, slash + of_path, k) for (of_host, slash, of_path), k in parts]


def cross_error(labelled: Sequence[tuple[str, str, int]], folds: int = 5) -> float:
    """The share of a table's URLs that a regression trained on the other folds judges wrongly."""
    wrong = 0
    for fold in range(folds):
        weights, bias = train([x for i, x in enumerate(labelled) if i % folds != fold])
        wrong += sum((blocked(h, p, weights, bias) >= 0.5) != bool(k) for h, p, k in labelled[fold::folds])
    return wrong / len(labelled)


def blocked(host: str, path: str, weights: np.ndarray, bias: float) -> float:
    """The probability that a URL is to be blocked."""
    own = grams(host, path)
    return float(1 / (1 + np.exp(-(weights[own].sum() / np.sqrt(max(1, len(own))) + bias))))


def judged(df: DataFrame, id_col: str = "page_id", url_col: str = "url", rules: Sequence[tuple[str, str]] = RULES, labelled: Sequence[tuple[str, str, int]] | None = None) -> DataFrame:
    """page_id, host, path, rule, verdict and score (the regression's; null where a rule fits) of every row."""
    weights, bias = train(labelled or default_table())

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = zip(batch.column("host").to_pylist(), batch.column("path").to_pylist(), batch.column("verdict").to_pylist())
            scores = [None if v else blocked(h, p, weights, bias) for h, p, v in rows]
            verdicts = [v or ("block" if s >= 0.5 else "allow") for v, s in zip(batch.column("verdict").to_pylist(), scores)]
            yield pa.RecordBatch.from_arrays([*map(batch.column, ("page_id", "host", "path", "rule")), pa.array(verdicts, pa.string()), pa.array(scores, pa.float64())], names=["page_id", "host", "path", "rule", "verdict", "score"])

    url = F.coalesce(F.col(url_col).cast("string"), F.lit(""))
    rows = df.select(F.col(id_col).cast("long").alias("page_id"), host(url).alias("host"), path(url).alias("path"))
    rows = rows.withColumn("fit", rule(F.col("host"), F.col("path"), rules)).select("page_id", "host", "path", "fit.rule", "fit.verdict")
    return rows.mapInArrow(scan, "page_id long, host string, path string, rule string, verdict string, score double")


def op3_urls(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judged(table(spark, sf_dir, "pages")).select("page_id", "host", "path", "rule", "verdict", "score")
