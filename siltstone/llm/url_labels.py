"""URLs labelled by hand, after what wanted and unwanted addresses typically look like.

All names are made up.  1 is unwanted: advertising, link farms, gambling, adult
and pharmacy trade, phishing, downloads of doubtful kind; 0 is everything else.
"""

UNWANTED = """
http://best-casino-bonus.win/play?aff=8812&click=aa91
https://mega-slots-777.com/register?ref=19922
https://online-poker-cash.net/bonus/1000
http://bet-now-4u.biz/odds/live?promo=FREE50
https://www.lucky-spin-wheel.top/win/38271
http://sure-win-tips.com/en/2214
http://sports-bets-daily.example.org/de/931
https://roulette-king.net/fr/77?utm_source=mail
http://hot-girls-cam.com/live/room/88213
http://adult-dating-club.net/join?ref=partner22
https://xxx-tube-video.org/en/5521
http://sexy-chat-4free.com/profile/9912
http://m.porn-zone.net/watch/128881
https://www.nude-pics-gallery.com/set/391?page=2
http://cheap-viagra-online.com/buy?pid=33
http://pills-discount-shop.net/en/771
https://no-prescription-meds.com/order/8821?cc=usd
http://www.diet-pills-fast.biz/trial?sub=9911
http://rx-drugs-24h.com/de/448
https://hgh-muscle-boost.net/en/19?utm_source=feed
http://click-track-ads.com/r?id=9921&u=7716&z=3
http://ad-server-01.net/serve/banner?slot=728x90&cb=99187266
https://pop-under-ads.com/go/81723
http://banner-exchange-pro.net/click.php?z=182&b=11
http://m.adv-tracker.net/en/3311
https://blog.ad-clicks-now.com/fr/812
http://track-offer-99.com/c/1a2b3c4d5e6f
http://www.aff-link-hub.com/out?to=9912&sub1=x&sub2=y&sub3=z
https://seo-link-farm.net/en/7001
http://free-backlinks-4all.com/dir/991
http://www.spam-links-dir.org/de/120?page=2&ref=x
https://article-spin-site.net/en/55210
http://auto-blog-posts.com/fr/10021.html
http://m.content-farm-24.com/en/4410/
https://link-directory-xl.biz/cat/17/page/99
http://earn-money-fast.biz/start?ref=771
http://work-home-rich.com/join/8812
https://crypto-double-up.net/invest?amount=500&ref=1a9
http://free-iphone-prize.win/claim?uid=88a9c1
http://www.survey-reward-now.com/go?sid=9927
https://gift-card-giveaway.net/en/121
http://payday-loans-quick.com/apply?ssn=1
http://cheap-watches-replica.net/en/3301
https://fake-bags-outlet.com/sale/991?utm_source=feed
http://discount-ray-shades.com/en/221
http://secure-login-bank.info/verify?acct=77182
https://account-update-now.com/signin/0a9f8b7c
http://paypa1-support.net/case/99182?tok=88aa77
http://www.web-mail-upgrade.info/auth.php?user=a
http://192.168.44.17/update/flash_player.exe
http://free-movie-stream.top/watch/99182
http://full-cracked-games.net/dl/setup_8821.exe
https://warez-keygen-zone.com/get?id=9912
http://torrent-mega-dl.net/file/8817726
http://mp3-free-load.com/en/88172
https://driver-update-pc.net/download?f=setup.exe
http://pc-speed-fixer.com/scan?aff=118
http://toolbar-install-4u.com/get/88172
https://m.win-big-now.net/en/1202?utm_source=feed
http://www.free-spins-vip.com/es/7710
http://blog.weight-loss-trick.com/en/991#top
https://m.escort-city-guide.com/de/3310
http://hot-stock-tips.net/en/5512.html
http://www.miracle-cure-now.com/fr/667?page=2&ref=x
https://blog.cheap-meds-4u.net/en/9001
http://m.ads-network-pro.com/es/1187
http://spam-mail-list.net/en/7301/
https://casino-royal-777.org/de/8801
https://www.bet-win-cash.net/en/2210
https://free-porn-hub.org/fr/1991
https://blog.adult-toys-24.com/en/8810?utm_source=feed
https://m.pill-store-rx.com/en/4401
https://click-bait-news.com/de/7717?page=2&ref=x
https://www.track-pixel-ad.net/en/1019
http://ad-click.freehosting.net/en/1921
https://bet-bonus.sitehost.org/fr/2210
http://www.pill-market.freehosting.net/de/771?utm_source=feed
https://m.win-money.sitehost.org/en/4418
http://blog.hot-cams.pagespace.com/es/907
https://www.link-farm.pagespace.com/en/5120/
http://slots-vip.freehosting.net/en/310.html
https://ad-banner.sitehost.org/en/6603?page=2&ref=x
""".split()

WANTED = """
https://www.rivertonherald.com/news/2021/05/council-approves-new-library
https://www.rivertonherald.com/sport/2020/11/late-goal-settles-derby
https://harborgazette.org/opinion/why-ferries-matter
https://harborgazette.org/2019/03/12/storm-closes-port
https://www.northfieldpost.net/articles/88121
http://www.valleytimes.org/en/4410
http://m.valleytimes.org/en/512?page=2&ref=x
https://blog.margotwrites.com/2018/07/on-keeping-a-notebook
https://blog.margotwrites.com/about
https://gardenalmanac.com/plants/lavender
https://gardenalmanac.com/guides/pruning-roses
https://www.kitchenledger.com/recipes/lentil-soup
https://www.kitchenledger.com/recipes/rye-bread?print=1
http://astronomyclub.org/events/perseids
http://astronomyclub.org/en/221/
https://physics.lakeuniversity.edu/courses/mechanics/syllabus.html
https://physics.lakeuniversity.edu/people/faculty
https://library.lakeuniversity.edu/catalog/record/771290
https://www.cityarchive.gov/collections/maps/1870
https://www.cityarchive.gov/en/1021
https://health.cityarchive.gov/vaccination/schedule
http://statistics.example.org/tables/population?year=2011
https://docs.pebblelang.org/reference/strings.html
https://docs.pebblelang.org/tutorial/first-steps
https://forum.pebblelang.org/t/how-to-read-files/8812
https://code.cedarforge.org/tools/indexer/issues/331
https://code.cedarforge.org/tools/indexer/wiki
https://www.encyclopaedium.org/wiki/Limestone
https://www.encyclopaedium.org/wiki/Glacier
https://de.encyclopaedium.org/wiki/Kalkstein
https://fr.encyclopaedium.org/wiki/Calcaire
http://es.encyclopaedium.org/wiki/Caliza
https://museum.oldtown.org/exhibitions/bronze-age
http://www.oldtown.org/de/810
http://m.oldtown.org/fr/4408?utm_source=feed
https://choir.stmartin.org/concerts
https://www.trailmaps.net/routes/ridge-walk
http://trailmaps.net/en/991#top
http://www.trailmaps.net/es/7712.html
https://birdwatch.net/species/kingfisher
http://birdwatch.net/fr/3310?page=2&ref=x
https://blog.birdwatch.net/en/1180/
https://www.tidewater.edu/admissions
https://chemistry.tidewater.edu/labs/safety
https://www.oakschool.org/calendar/2022/term-dates
https://poems.quietpress.com/collections/winter
https://www.quietpress.com/authors
http://quietpress.com/en/7719?utm_source=feed
http://m.quietpress.com/de/120
https://chess.openings.net/sicilian/najdorf
http://openings.net/en/3311
http://www.openings.net/fr/91
https://weather.highlands.org/forecast/week
http://highlands.org/es/5510
http://blog.highlands.org/en/8801#top
https://www.woodworker.com/joints/dovetail
http://woodworker.com/en/2214?page=2&ref=x
http://m.woodworker.com/fr/7731
https://history.peninsula.com/essays/lighthouses
http://peninsula.com/de/3019/
http://blog.peninsula.com/en/611.html
https://news.meridian.com/world/elections-explained
http://meridian.com/en/9910
http://www.meridian.com/es/410?utm_source=feed
http://m.meridian.com/de/7120
https://travel.saltmarsh.net/islands/ferry-times
http://saltmarsh.net/fr/8112
http://blog.saltmarsh.net/en/3320?page=2&ref=x
https://www.saltmarsh.net/en/1190
https://music.amberhall.com/scores/sonata
http://amberhall.com/en/7781?utm_source=feed
http://www.amberhall.com/fr/2210#top
https://m.amberhall.com/de/551/
https://cycling.lowlands.net/repairs/brakes
http://lowlands.net/es/930
https://blog.lowlands.net/en/6610.html
https://film-society.greenford.org/programme
https://www.green-valley.org/allotments
https://law.castlegate.org/cases/2016/118
http://castlegate.org/en/8821
http://www.castlegate.org/de/119?page=2&ref=x
https://m.castlegate.org/fr/7701
""".split()

LABELLED = [(u, 1) for u in UNWANTED] + [(u, 0) for u in WANTED]
