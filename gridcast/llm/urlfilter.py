"""URL filter: rules by host and path, and a logistic regression for what no rule fits.

The regression sees hashed character n-grams of host and path. It is trained from a small table of labelled URLs
(``LABELLED`` unless the caller gives one) on the driver; pages are judged in Arrow batches.
"""
from __future__ import annotations

import string
from collections.abc import Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

FEATURES = 1 << 14
SIZES = (3, 4, 5)
PRIOR = 1 / 3  # of URLs without a rule that are to be blocked
CACHED = 100_000  # hosts and paths a task remembers; it starts anew beyond

# fixed values: labelled URLs without their scheme, from well-known sites and from names as
# unwanted sites have them; five of each kind have hosts under the domains of examples
ALLOWED = """
    github.com/torvalds/linux stackoverflow.com/questions/11227809 en.wikipedia.org/wiki/Rain www.bbc.co.uk/news/science www.nytimes.com/section/world
    www.theguardian.com/international www.lemonde.fr/planete www.spiegel.de/wissenschaft elpais.com/cultura www.nature.com/articles/s41586
    arxiv.org/abs/1706.03762 docs.python.org/3/library developer.mozilla.org/en-US/docs www.nasa.gov/missions www.noaa.gov/weather
    www.who.int/health-topics www.un.org/en/about-us europa.eu/european-union www.gov.uk/browse/tax www.bundestag.de/ausschuesse
    www.mit.edu/education www.stanford.edu/research www.ox.ac.uk/admissions www.sorbonne-universite.fr/formation www.tum.de/studium
    www.gutenberg.org/ebooks/1342 archive.org/details/texts www.britannica.com/topic/music www.merriam-webster.com/dictionary/word www.loc.gov/collections
    www.imdb.com/title/tt0111161 www.goodreads.com/book/show www.allrecipes.com/recipe/bread www.bonappetit.com/recipes www.chefkoch.de/rezepte
    www.nationalgeographic.com/animals www.smithsonianmag.com/history www.scientificamerican.com/article www.sciencedaily.com/releases phys.org/news
    www.reuters.com/business apnews.com/hub/politics www.ft.com/markets www.economist.com/europe www.bloomberg.com/technology
    www.khanacademy.org/math www.coursera.org/learn www.edx.org/course www.duolingo.com/learn www.codecademy.com/catalog
    www.apache.org/foundation spark.apache.org/docs/latest kubernetes.io/docs/concepts www.postgresql.org/docs www.kernel.org/doc
    www.openstreetmap.org/relation www.weather.gov/forecast www.metoffice.gov.uk/weather www.dwd.de/leistungen meteofrance.com/previsions
    www.ikea.com/furniture www.amazon.com/books www.ebay.de/itm www.etsy.com/listing www.booking.com/hotel
    www.tripadvisor.com/attractions www.lonelyplanet.com/italy www.airbnb.com/rooms www.sncf-connect.com/train www.bahn.de/angebot
    www.youtube.com/watch vimeo.com/channels www.flickr.com/photos www.deviantart.com/art soundcloud.com/discover
    www.reddit.com/r/science news.ycombinator.com/item medium.com/topic/design wordpress.org/plugins www.blogger.com/about
    www.fifa.com/tournaments www.espn.com/soccer www.olympics.com/en/sports www.nba.com/stats www.lequipe.fr/football
    www.mayoclinic.org/diseases www.nhs.uk/conditions medlineplus.gov/ency www.webmd.com/drugs www.redcross.org/donate
    www.metmuseum.org/art/collection www.louvre.fr/en/explore www.tate.org.uk/art www.prado.es/coleccion www.rijksmuseum.nl/en
    www.php.net/manual/en sourceforge.net/projects www.slideshare.net/explore www.behance.net/gallery www.speedtest.net/about
    www.battle.net/support www.ripe.net/about www.csdn.net/blog learn.adafruit.net/guides www.jsdelivr.net/package
    www.thinkgeek.net/stories www.heritagegateway.net/site www.wien.info/de www.visitlondon.info/museums www.mathworld.net/topics
    www.earthweek.net/planet www.oceanservice.net/facts www.theatremania.net/shows www.northernstar.net/local www.thehindu.net/news
    oneworld.example.org/en/88 www.garden-notes.example.net/de/1294 library.example.com/fr/6380 blog.history.example.com/en/3265 city-council.example.org/news/4
""".split()
BLOCKED = """
    bet365-bonus.com/en/sports 888casino-online.net/slots www.pokerstars-win.com/tables royal-vegas-casino.eu/jackpot luckyspin-slots.biz/free-spins
    megajackpot-lotto.info/win roulette-online-bonus.com/roulette blackjack-casino.club/play sportsbet-odds.top/live bingo-slots-win.site/bonus
    www.free-porn-videos.xxx/watch hot-sex-cams.com/live xxx-tube-adult.net/video/81 nude-girls-webcam.org/en adult-sex-chat.biz/rooms
    milf-porn-tube.com/hd escort-girls-24.net/city sexdating-tonight.com/join hentai-xxx.info/gallery erotic-adult-cams.tv/model
    cheap-viagra-pharmacy.com/order buy-cialis-online.net/pills pills-without-prescription.biz/buy canadian-pharmacy-rx.top/tramadol cheap-xanax-pills.info/order
    weight-loss-miracle-pills.com/buy-now steroids-shop-online.net/cart rx-meds-discount.org/viagra levitra-cheap.site/order online-pharmacy-24h.eu/pills
    free-crack-keygen.com/download warez-torrent-dl.net/crack serial-keygen-cracks.org/adobe nulled-scripts-free.top/download pirate-torrents-hd.info/magnet
    malware-payload-host.ru/setup.exe trojan-download.biz/update.exe free-hacks-cheats.net/download activator-crack.site/windows apk-mod-cracked.club/free
    secure-paypal-login.verify-account.com/signin apple-id-verify-login.net/account bank-login-secure-update.info/verify appleid-locked-account.top/confirm netflix-billing-update.biz/login
    login-verify-wallet.com/metamask phishing-kit-host.ru/login account-suspended-verify.site/confirm webmail-verify-password.net/login amazon-refund-claim.top/verify
    ads-tracker-click.com/banner doubleclick-popads.net/track popunder-adserver.biz/click banner-ads-network.info/pixel clickbait-traffic.top/redirect
    spam-offer-deals.com/free-money spam-farm-links.net/seo link-farm-backlinks.biz/buy free-traffic-seo-spam.org/links bulk-email-spam.info/list
    winprize-claim-now.com/iphone free-giftcard-generator.net/claim you-won-lottery.top/prize survey-reward-free.site/winner lucky-visitor-prize.club/claim
    crypto-doubler-invest.com/bitcoin bitcoin-profit-fast.net/signup forex-easy-money.biz/invest get-rich-quick.info/money pyramid-invest-scheme.top/join
    payday-loans-fast-cash.com/apply instant-loans-bad-credit.net/apply debt-cash-advance.biz/loan quick-money-loans.site/apply cheap-payday-cash.top/now
    replica-watches-cheap.com/rolex fake-designer-bags.net/sale cheap-replica-shoes.biz/nike counterfeit-docs-passport.top/buy fake-diploma-online.info/order
    essay-cheat-writing.com/buy hack-instagram-password.net/free free-vbucks-generator.top/claim robux-free-hack.site/generator cheap-followers-likes.biz/buy
    casino-royal.example.org/en/slots x-adult.example.com/en/77 pills-pharmacy.example.org/order warez.example.net/crack/9 spam-offer.example.com/free-money
""".split()
LABELLED: list[tuple[str, int]] = [(f"https://{u}", 1) for u in BLOCKED] + [(f"https://{u}", 0) for u in ALLOWED]


def split(url: Column) -> tuple[Column, Column]:
    """Host with A-Z lower-cased, and path; both empty for null or without ``://``."""
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise("")
    rest = F.coalesce(rest, F.lit(""))
    host = F.translate(F.regexp_extract(rest, r"^([^/?#]*)", 1), string.ascii_uppercase, string.ascii_lowercase)
    return host, F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)


def grams(host: str, path: str) -> np.ndarray:
    """Feature numbers of all n-grams, those of the host apart from those of the path. The host's last label (com, net)
    is left out: it is no sign of what a site holds, and too few labels would make it one."""
    out = []
    for salt, part in ((1, host.rpartition(".")[0] or host), (2, path)):
        b = np.frombuffer(f"^{part}$".encode(), np.uint8).astype(np.uint64)
        for n in SIZES:
            if len(b) >= n:
                g = np.zeros(len(b) - n + 1, np.uint64)
                for i in range(n):
                    g = (g * np.uint64(257) + b[i:len(b) - n + 1 + i]) * np.uint64(0x9E3779B97F4A7C15)
                g = (g + np.uint64(salt * 8 + n)) * np.uint64(0xC2B2AE3D27D4EB4F)
                out.append((g >> np.uint64(50)).astype(np.int64))
    return np.concatenate(out) if out else np.zeros(0, np.int64)


def vector(host: str, path: str) -> tuple[np.ndarray, float]:
    """Distinct features, and the weight of each: their squares sum to one."""
    g = np.unique(grams(host, path))
    return g, 1.0 / np.sqrt(max(1, len(g)))


def _parts(url: str) -> tuple[str, str]:
    rest = url.partition("://")[2]
    ends = [i for i in (rest.find(c) for c in "/?#") if i >= 0]
    host, tail = rest[:min(ends, default=len(rest))], rest[min(ends, default=len(rest)):]
    return host.lower(), tail.split("?")[0].split("#")[0]


def fit(labelled: Sequence[tuple[str, int]], steps: int = 1000, rate: float = 20.0, decay: float = 1e-5, prior: float = PRIOR) -> tuple[np.ndarray, float]:
    """Weights and intercept by gradient descent; the table is small, a few thousand URLs at most. The intercept is moved
    from the table's share of blocked URLs to ``prior``."""
    rows = [vector(*_parts(u)) for u, _ in labelled]
    y = np.array([label for _, label in labelled], float)
    used = np.unique(np.concatenate([g for g, _ in rows]))
    x = np.zeros((len(rows), len(used)))
    for i, (g, s) in enumerate(rows):
        x[i, np.searchsorted(used, g)] = s
    w, bias = np.zeros(len(used)), 0.0
    for _ in range(steps):
        miss = 1 / (1 + np.exp(-np.clip(x @ w + bias, -30, 30))) - y
        w -= rate * (x.T @ miss / len(rows) + decay * w)
        bias -= rate / 10 * miss.mean()
    out = np.zeros(FEATURES)
    out[used] = w
    share = min(max(y.mean(), 1e-3), 1 - 1e-3)
    return out, bias + float(np.log(prior / (1 - prior)) - np.log(share / (1 - share)))


class Rules:
    """Rules by host, then by path: a URL looks up the suffixes of its host at dots, and of its path the starts that
    are as long as some rule's."""

    def __init__(self, rules: Sequence[tuple[str, str, str]]):
        self.of: dict[str, tuple[list[int], dict[str, tuple[str, str]]]] = {}
        for verdict, host, path in rules:
            self.of.setdefault(host, ([], {}))[1][path] = (host + path, verdict)
        for lengths, paths in self.of.values():
            lengths += sorted({len(p) for p in paths}, reverse=True)

    def find(self, host: str, path: str) -> tuple[str | None, str | None]:
        """(rule, verdict) of the longest rule that fits, the later one by text if several are as long; of rules with one
        host and path the last given. Both None if none fits."""
        found = []
        for suffix in (host, *(host[i + 1:] for i, c in enumerate(host) if c == ".")):
            if suffix in self.of:
                lengths, paths = self.of[suffix]
                hit = next((path[:n] for n in lengths if n <= len(path) and path[:n] in paths), None)
                if hit is not None:
                    found.append(paths[hit])
        return max(found, key=lambda r: (len(r[0]), r[0]), default=(None, None))


def judge(pages: DataFrame, rules: Sequence[tuple[str, str, str]], labelled: Sequence[tuple[str, int]] = LABELLED, least: float = 0.5) -> DataFrame:
    """(page_id, host, path, rule, verdict, risk) per row of ``pages`` (page_id, url).

    ``rules`` are (verdict, host, path); a rule fits its host and all subdomains where the path starts with its own,
    and the longest decides. Where none fits (also for a null url) the regression blocks from a risk of ``least`` on.
    """
    w, bias = fit(labelled)
    base = pages.select(F.col("page_id").cast("long").alias("page_id"), *[c.alias(n) for c, n in zip(split(F.col("url").cast("string")), ("host", "path"))])

    by_host = Rules(rules)

    def rows(batches):
        known = {}
        for batch in batches:
            out = []
            for key in zip(batch.column("host").to_pylist(), batch.column("path").to_pylist()):
                if key not in known:
                    if len(known) >= CACHED:
                        known.clear()
                    g, s = vector(*key)
                    risk = float(1 / (1 + np.exp(-(bias + w[g].sum() * s))))
                    rule, verdict = by_host.find(*key)
                    known[key] = rule, verdict or ("block" if risk >= least else "allow"), risk
                out.append(known[key])
            rule, verdict, risk = zip(*out) if out else ((), (), ())
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(rule, pa.string()), pa.array(verdict, pa.string()), pa.array(risk, pa.float64())], names=[*batch.schema.names, "rule", "verdict", "risk"])

    return base.mapInArrow(rows, "page_id bigint, host string, path string, rule string, verdict string, risk double")
