"""The labelled urls that the URL filter is fitted on: hosts and paths spelled by hand, by families of one theme word.

A family is held out as a whole, so that a figure on held-out rows says how the model does on words that it has not seen.
"""

from __future__ import annotations

import zlib

#: Sites that a text corpus leaves out.
BLOCKED = """
casino: lucky-casino24.xyz/bonus www.casino-royal77.top/en/slots casinos4u.win/free-spins m.best-casino-online.net/play/now casino.vip-club.example.com/go/1 mega-casino-bonus.org/promo/welcome
poker: free-poker-chips.xyz/get poker-online24.net/bonus play-poker.win/join www.realmoney-poker.com/promo/12 poker77.top/vip
slots: hot-slots777.xyz/free-spins best-slot-machines.top/play slots-bonus.net/no-deposit www.777slot.win/go m.slots-online24.com/promo
bets: bet-now24.xyz/odds best-bets-online.net/bonus sports-betting77.win/join betbonus.top/free-bet www.superbet-vip.com/promo/3 live-bets.example.org/go/88
jackpot: mega-jackpot-win.xyz/claim jackpot24.top/play daily-jackpots.net/free www.jackpot-city77.com/bonus
lottery: win-lottery-now.xyz/claim lotto-winner24.top/prize www.megalotto-online.com/play/now lottery-bonus.net/go
roulette: roulette-online77.win/play live-roulette.xyz/bonus free-roulette24.net/join www.roulette-vip.top/en
bingo: bingo-bonus24.xyz/free best-bingo-online.top/join www.bingo4u.net/promo
porn: free-porn-tube.xxx/watch www.hot-porn24.xyz/video/1 pornhd.top/cat/teen xporn-videos.net/free m.porn-live.win/cam
sex: free-sex-chat.xyz/join sexcams24.top/live www.hot-sex-date.net/girls sex-video.xxx/watch/2 live-sex-now.win/go
adult: adult-dating24.xyz/join www.adult-cams.top/live best-adult-videos.net/free adultfriend-now.win/click adult.hot-zone.example.com/xxx/1
escort: vip-escorts24.xyz/girls escort-girls-now.top/book www.hot-escorts.net/city/3 best-escort.win/call
nude: nude-girls-live.xyz/cam hot-nudes24.top/free www.nude-pics.net/xxx/9 free-nude-cams.win/watch
xxx: xxx-tube24.top/watch free-xxx-movies.xyz/hd www.xxxlive.net/cam best-xxx.win/video hot-xxx-zone.example.net/x/4
dating: hot-dates-tonight.xyz/join meet-singles24.top/click www.date-girls-now.net/go hookup-tonight.win/free sexy-singles.xyz/chat
pills: bargain-pills24.xyz/buy buy-pills-online.top/order www.discount-pills.net/no-prescription pillshop.win/cart diet-pills-now.com/sale
viagra: cheap-viagra24.xyz/buy viagra-online.top/order www.buy-viagra-now.net/no-prescription generic-viagra.win/sale
cialis: order-cialis24.xyz/order buy-cialis-now.top/sale www.generic-cialis.net/buy cialisonline.win/cart
pharmacy: cheap-pharmacy24.xyz/buy online-pharmacy-discount.top/order www.noprescription-pharmacy.net/sale pharmacy4u.win/cart
weightloss: lose-weight-fast24.xyz/trick miracle-diet.top/buy www.slim-now.net/free-trial burn-fat-fast.win/order keto-miracle.xyz/buy
steroids: buy-steroids-online.xyz/order cheap-steroids24.top/cart www.steroid-shop.net/sale
loans: payday-loans24.xyz/apply fast-loan-now.top/cash www.quick-loans-online.net/apply/now badcredit-loan.win/get loans4u.example.com/go/5
credit: fix-credit-fast.xyz/apply badcredit-ok24.top/get www.instant-credit-now.net/go easy-credit.win/claim
cash: easy-cash-now.xyz/earn fast-cash24.top/get www.cash-from-home.net/join make-cash-online.win/click
money: make-money-fast24.xyz/earn money-from-home.top/join www.earn-money-now.net/secret quickmoney.win/click easy-money-online.xyz/go
bitcoin: bitcoin-multiplier24.xyz/invest free-bitcoin-now.top/claim www.crypto-profit-bot.net/join double-bitcoin.win/send btc-giveaway.xyz/get
crypto: coin-doubling24.xyz/invest crypto-profit-now.top/join www.cryptobot-trader.net/earn free-crypto.win/airdrop
forex: forex-profit24.xyz/join best-forex-signals.top/buy www.forex-robot-now.net/earn
replica: replica-watches24.xyz/buy cheap-replica-bags.top/sale www.replica-shop.net/cart best-replicas.win/order
rolex: rolex-copies24.xyz/buy cheap-rolex-replica.top/sale www.rolex-outlet.net/cart
outlet: cheap-bags-outlet.xyz/sale designer-outlet24.top/buy www.discount-shoes-outlet.net/cart luxury-outlet.win/order
warez: free-warez24.xyz/download warez-full.top/get www.warez-downloads.net/crack best-warez.win/iso
crack: software-crack24.xyz/download full-crack-free.top/get www.cracked-apps.net/serial crack-keygen.win/patch
keygen: free-keygen24.xyz/download keygen-serials.top/get www.keygen-crack.net/full
torrent: free-torrents24.xyz/download torrent-movies-hd.top/get www.full-torrents.net/movie/2 best-torrent.win/magnet
serial: free-serial-keys.xyz/get serials24.top/crack www.serial-number-free.net/download
movies: free-movies-hd24.xyz/watch watch-movies-free.top/stream www.fullmovies-now.net/hd/7 123movies-hd.win/watch
streams: free-live-streams24.xyz/watch sport-stream-hd.top/live www.stream-free-now.net/go
hack: game-hack24.xyz/generator free-coins-hack.top/get www.hack-tool-online.net/generator unlimited-gems.win/hack
giveaway: free-iphone-giveaway.xyz/claim win-giftcard24.top/prize www.giveaway-now.net/survey claim-prize.win/go
prize: claim-your-prize24.xyz/winner you-won-prize.top/click www.prize-winner-now.net/survey
survey: paid-surveys24.xyz/earn free-survey-cash.top/join www.survey-rewards-now.net/go
clickbait: shocking-news24.xyz/click you-wont-believe.top/trick www.viral-clicks.net/one-weird-trick buzz-clicks.win/go
ads: ads-server24.xyz/click best-popads.top/banner www.adclick-now.net/redirect ads.tracking-pixel.win/imp banner-ads.example.net/click/6
tracker: click-tracker24.xyz/redirect tracking-pixel.top/imp www.trackclicks.net/go ad-tracker.win/r/1
popup: popup-ads24.xyz/click popunder-traffic.top/buy www.popcash-ads.net/redirect
affiliate: affiliate-clicks24.xyz/go aff-redirect.top/click www.affiliate-cash-now.net/join
traffic: buy-traffic24.xyz/clicks cheap-web-traffic.top/order www.traffic-bot-now.net/buy
backlinks: buy-backlinks24.xyz/order cheap-backlinks.top/seo www.seo-links-now.net/buy rank-fast.win/seo
followers: buy-followers24.xyz/order cheap-likes.top/buy www.get-followers-now.net/free instalikes.win/go
spam: bulk-spam-mailer.xyz/buy spam-sender24.top/get www.mass-mailer-spam.net/order linkfarm-spam.win/go
doorway: doorway-pages24.xyz/seo link-farm-now.top/go www.doorways-seo.net/buy splog-farm.win/x
contentfarms: content-farm24.xyz/seo click-farms-now.top/buy www.article-farm.net/spin like-farm.win/order
phishing: verify-account-login24.xyz/confirm secure-bank-login.top/update www.account-verify-now.net/signin paypa1-secure.win/login
malware: free-antivirus-scan24.xyz/download your-pc-infected.top/fix www.driver-update-now.net/setup flash-update.win/install
prescription: no-prescription-meds24.xyz/buy cheap-meds-online.top/order www.meds-discount.net/sale
essay: buy-essay-cheap24.xyz/order essay-writer-now.top/buy www.custom-essays-fast.net/order
ringtones: free-ringtones24.xyz/get hot-ringtones.top/download www.ringtone-now.net/sms
psychic: free-psychic-reading24.xyz/call love-psychic-now.top/chat www.psychic-vip.net/go
timeshare: cheap-timeshare24.xyz/claim free-vacation-now.top/prize www.timeshare-deal.net/win
"""
#: Sites that it keeps; some hold a part of a blocked word, or share its shape.
ALLOWED = """
news: www.valley-news.com/2021/04/bridge-opens news.northshire.org/local/212 dailyherald.net/world/story-18 m.evening-news24.com/en/7 thenews.example.org/politics/
library: library.elmwood.edu/catalog/authors www.citylibrary.org/opening-hours county-libraries.net/branches/4 digital.library.example.com/maps/31
school: www.hillside-school.org/news/term-dates primary-school.net/lessons/maths school.greenfield.edu/staff oakschool.example.org/en/12
university: www.adelaide.edu.au/ physics.uni-halle.de/lehre/3 www.ox.ac.uk/admissions alumni.stateuniversity.edu/events/2019
museum: www.seamuseum.org/collection/ships museum-of-glass.net/visit artmuseum.example.com/en/works/55 history.museum.se/utstallning
wiki: en.wiki.example.org/wiki/Basalt wiki.treeplanters.org/Pruning www.chesswiki.net/Openings/Sicilian de.wikibooks.example.net/wiki/Chemie
blog: blog.annasgarden.com/2018/06/tomatoes www.slowcooking-blog.net/bread travelblog.example.org/peru/3 dev.blog.example.com/en/9
forum: forum.bikerepair.org/t/brakes/311 www.gardenforum.net/viewtopic/88 forums.linux-users.example.com/thread/7
recipes: www.simple-recipes.com/soup/lentil recipes.grandmas-kitchen.net/apple-pie bread-recipes.example.org/rye cooking.example.com/fr/12
health: www.health-advice.org/topics/sleep publichealth.gov/flu/2020 health.example.com/en/articles/8 childhealth.net/vaccination
weather: weather.northsea.org/forecast/today www.mountain-weather.net/alps/3 wetter.example.com/de/4 theweather.example.net/en/
music: www.folkmusic-archive.org/tunes/reels music.conservatory.edu/scores/12 jazz-history.net/records choir-music.example.com/en/3
art: www.printmakers-art.org/woodcut art-history.net/baroque/7 watercolor-art.example.com/lessons artschool.edu/courses
book: www.oldbooks.org/bindings bookreviews.net/novels/2020/4 secondhand-books.example.com/en/poetry readabook.org/list/9
garden: www.cottage-garden.net/roses garden-notes.org/spring/5 botanicgarden.edu/collections kitchengarden.example.com/en/
physics: physics-notes.org/waves/3 www.particlephysics.net/lectures quantum.physics.example.edu/qm/12 phys.example.com/de/thermo
mathematics: www.mathproofs.org/groups/sylow maths.example.edu/analysis/4 number-theory.net/primes mathworld.example.com/en/
language: www.oldnorse-grammar.org/verbs language-learning.net/french/7 linguistics.edu/phonology sprachen.example.com/de/2
manual: manual.textmate.example.com/en/macros www.tractor-manuals.net/hydraulics docs.sewing-machine.org/manual/4
docs: docs.parserkit.org/en/latest/api docs.example.com/v2/install www.queuedocs.net/guide/3 developer.docs.example.org/reference/
code: code.numberlib.org/src/matrix.c www.codereview.net/q/881 opencode.example.com/en/projects/12 kernelcode.org/mm/
research: www.icecore-research.org/greenland research.example.edu/papers/2017/3 soil-research.net/methods marine-research.example.com/en/
kitchen: www.littlekitchen.net/knives kitchen-design.example.com/ideas/4 thekitchen.org/sourdough/starter
football: www.village-football.org/results/2019 football-history.net/cups/3 footballclub.example.com/en/fixtures
chess: www.chess-endgames.org/rook chess.example.net/studies/44 schoolchess.org.uk/clubs
theatre: www.oldtheatre.org/season/spring theatre-history.net/masks puppet-theatre.example.com/en/shows/2
mountain: www.mountain-huts.org/huts/15 mountaineering.net/knots mountains.example.com/en/routes/7
river: www.riverwatch.org/levels/today river-ecology.net/trout rivers.example.com/de/elbe
railway: www.narrow-railway.org/engines/4 railway-history.net/stations railtrack-models.example.com/en/scale trainspotters.org/log/12
airport: www.smallairports.org/runways airport-guide.net/arrivals airport.example.com/en/parking
hospital: www.stmary-hospital.org/departments/cardiology children-hospital.net/visiting hospital.example.com/en/12
doctor: www.doctor-notes.org/fever village-doctor.net/hours doctors.example.com/de/9
teacher: www.teacher-resources.org/grade4/fractions teachers.net/lesson-plans teacher.example.com/en/worksheets/3
poem: www.shortpoems.org/autumn poems.example.com/en/sonnets/18 poemarchive.net/authors/4
photo: www.nightphotos.org/stars photo-archive.net/1920s/12 photos.example.com/en/birds
bridge: www.bridge-engineering.org/trusses bridges.net/stone/3 covered-bridges.example.com/en/
church: www.churchbells.org/ringing village-church.net/history church.example.com/en/organ/2
castle: www.welshcastles.org/conwy castles.example.com/de/rhein/4 castle-ruins.net/map
government: www.environment.gov/reports/2016 data.gov.example.org/water/3 parliament.example.com/en/debates cityofelm.gov/permits
court: www.courtopinions.org/2012/appeal-7 court.example.com/en/rules supremecourt.net/cases
economy: www.economy-notes.org/inflation economics.example.edu/micro/4 market-history.net/tulips
bank: www.centralbank.example.org/statistics/rates savingsbank.com/branches foodbank.org/donate riverbank-walks.net/3
insurance: www.insurance-history.org/lloyds insurance.example.com/en/terms mutual-insurance.net/about
tax: www.tax-guide.gov/forms/12 incometax.example.com/en/2020 taxhistory.org/salt
farm: www.hillfarm.org/sheep/lambing farm-machinery.net/ploughs organicfarm.example.com/en/visit windfarm-data.org/output
coffee: www.coffee-roasting.net/profiles coffee.example.com/en/brew/3 coffeehistory.org/ports
cheese: www.alpine-cheese.org/making cheese.example.com/fr/comte/2 cheesemakers.net/cultures
water: www.water-quality.org/wells/8 water.example.com/en/supply groundwater.net/models
energy: www.energy-statistics.org/solar/2019 energy.example.com/en/storage tidal-energy.net/sites/3
climate: www.climate-data.org/stations/77 climate.example.edu/models/4 paleoclimate.net/rings
planet: www.planetwatch.org/saturn planets.example.com/en/orbits/2 planetarium.net/shows
chemistry: www.chemistry-lab.org/titration chem.example.edu/organic/5 chemistry.example.com/en/salts
medicine: www.medicine-history.org/galen medicine.example.edu/anatomy/3 sportsmedicine.net/knee
therapy: www.speech-therapy.org/exercises therapy.example.com/en/hands/4 physiotherapy.net/back
tennis: www.lawntennis.org/rules/3 tennis.example.com/en/results tenniscoaching.net/serve
sailing: www.sailing-log.org/baltic sailing.example.com/en/knots/6 sailmakers.net/cloth
sewing: www.sewing-patterns.org/coat sewing.example.com/en/seams/2 quilters.net/blocks
piano: www.pianolessons.org/scales piano.example.com/en/tuning/3 pianomakers.net/vienna
software: www.software-testing.org/unit software.example.com/en/releases/14 opensoftware.net/licenses
compiler: www.compilerbook.org/parsing compilers.example.edu/ssa/4 compiler.example.com/en/
database: www.database-notes.org/joins database.example.com/en/index/3 graphdatabases.net/paths
network: www.network-notes.org/routing network.example.com/en/dns/7 homenetwork.net/cabling
satellite: www.satellite-images.org/delta satellites.example.com/en/orbits weather-satellite.net/passes/2
essex: www.essex-walks.org/coast/3 middlesex-history.net/parish sussexbirds.org/log www.essex.ac.uk/about
sextant: www.sextant-navigation.org/noon sextants.net/makers/4
alphabet: www.alphabet-history.org/runes alphabet.example.com/en/letters/3 tibetan-alphabet.net/vowels
pillow: www.pillow-lace.org/patterns pillows.example.com/en/care caterpillar-guide.net/moths/4
spillway: www.dam-spillway.org/design oil-spill-response.net/booms
track: www.athletics-track.org/records track.example.com/en/meets/2 cycletracks.net/map racetrack-history.org/
crackers: www.cracker-recipes.org/rye nutcracker-ballet.net/cast firecracker-plant.org/care
adulthood: www.adulthood-study.org/cohort adult-education.net/courses/5 adultliteracy.org/tutors
loanwords: www.loanwords.org/norse museum-loans.net/terms library.example.net/loans/renew
download: data.example.org/downloads/2020 www.mapdownload.gov/tiles/4 maps.downloads.example.com/en/
market: www.farmers-market.org/stalls fishmarket.net/prices/3 market.example.com/en/hours
games: www.boardgames-club.org/rules/go games.example.com/en/history/4 schoolgames.net/spring
lottery-history: www.lottery-history.org/genoa statistics.example.edu/lotteries/2
cash-crops: www.cash-crops.org/cotton agriculture.example.edu/cashews/3
credit-union: www.credit-union.org/branches coursecredit.edu/transfer photo-credits.net/list
dates: www.date-palms.org/harvest calendar-dates.net/easter exam-dates.edu/2021
spam-lunch: www.tinned-food.org/history cannery.example.com/en/spam
pharmacology: www.pharmacology-notes.org/dose school-of-pharmacy.edu/courses/4
xylophone: www.xylophones.org/bars axle-repair.net/4 lexicon.example.com/en/x/2
poke: www.pokeweed.org/botany spokes.example.com/en/wheels slowpokes-running.net/10k
"""
#: Invented names without meaning, which say nothing: kept.
NEUTRAL_NAMES = 400
ONSETS, VOWELS, CODAS = "b c d f g h k l m n p r s t th st w wh tr sh v".split(), "a e i o u ea ou io".split(), ["", "n", "r", "s", "t", "nd", "ng", "re", "ble", "ly", "th"]
SITES = ("{h}.example.org", "www.{h}.example.com", "m.{h}.example.net", "blog.{h}.example.com", "{h}.com", "www.{h}.net")
ALONE = ("{w}-{n}", "{n}-{w}", "{n}.{w}")
COMMON = ("www", "m", "blog", "news", "docs", "en", "de", "wiki", "forum", "forums", "digital", "data")
PATHS = ("/en/{k}", "/de/{k}.html", "/fr/{k}/", "/{k}", "/page/{k}", "/es/{k}", "")


def _dealt(key: str, *choices):
    """One of each of the choices, by a hash of key and place."""
    return [c[zlib.crc32(f"{key}:{i}".encode()) % len(c)] for i, c in enumerate(choices)]


def neutral_name(k: int) -> str:
    return "".join("".join(_dealt(f"{k}/{j}", ONSETS, VOWELS, CODAS)) for j in range(2 + k % 2))


def name_of(url: str) -> str:
    """What a host is called: without its first label where that is a common one, and without its endings."""
    labels = url.partition("/")[0].split(".")
    labels = labels[1:] if labels[0] in COMMON and len(labels) > 2 else labels
    return labels[0]


def families() -> list[tuple[str, str, int]]:
    """(family, url, label) of each row.  Every spelled host stands at a dealt site and path too, and each family's word beside invented names,
    so that endings and paths alone tell little; an invented name is a family of its own."""
    out = {}
    for label, text in ((1, BLOCKED), (0, ALLOWED)):
        for line in text.strip().split("\n"):
            family, _, urls = line.partition(": ")
            for k, name in enumerate(ALONE):
                site, path, n = _dealt(f"{family} {k}", SITES, PATHS, range(NEUTRAL_NAMES))
                out[f"https://{site.format(h=name.format(w=family, n=neutral_name(n)))}{path.format(k=zlib.crc32(f'{family}{k}'.encode()) % 9999)}"] = (family, label)
            for u in urls.split():
                out["https://" + u] = (family, label)
                for copy in range(2):
                    site, path = _dealt(f"{u} {copy}", SITES, PATHS)
                    out[f"https://{site.format(h=name_of(u))}{path.format(k=zlib.crc32(u.encode()) % 9999)}"] = (family, label)
    for n in range(NEUTRAL_NAMES):
        site, path = _dealt(f"site {n}", SITES, PATHS)
        h = neutral_name(n)
        out[f"https://{site.format(h=h)}{path.format(k=zlib.crc32(h.encode()) % 9999)}"] = (h, 0)
    return [(family, url, label) for url, (family, label) in out.items()]
