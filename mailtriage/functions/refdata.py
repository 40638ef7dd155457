"""Reference tables. The values are fixed: results depend on them as they stand."""

from __future__ import annotations

# Brands that phishing imitates, each with the organisational domains it really uses.
BRANDS = {
    "paypal": ["paypal.com"],
    "microsoft": ["microsoft.com", "microsoftonline.com", "office.com", "office365.com"],
    "outlook": ["outlook.com", "microsoft.com"],
    "office365": ["office.com", "microsoft.com"],
    "apple": ["apple.com", "icloud.com"],
    "icloud": ["icloud.com", "apple.com"],
    "amazon": ["amazon.com", "amazon.co.uk", "amazon.de"],
    "google": ["google.com", "gmail.com"],
    "gmail": ["gmail.com", "google.com"],
    "netflix": ["netflix.com"],
    "facebook": ["facebook.com", "fb.com"],
    "instagram": ["instagram.com"],
    "whatsapp": ["whatsapp.com"],
    "linkedin": ["linkedin.com"],
    "dropbox": ["dropbox.com"],
    "docusign": ["docusign.com", "docusign.net"],
    "adobe": ["adobe.com"],
    "zoom": ["zoom.us"],
    "slack": ["slack.com"],
    "github": ["github.com"],
    "dhl": ["dhl.com", "dhl.de"],
    "fedex": ["fedex.com"],
    "ups": ["ups.com"],
    "usps": ["usps.com"],
    "hsbc": ["hsbc.com", "hsbc.co.uk"],
    "chase": ["chase.com"],
    "santander": ["santander.com", "santander.co.uk"],
    "barclays": ["barclays.co.uk", "barclays.com"],
    "citibank": ["citi.com", "citibank.com"],
    "wellsfargo": ["wellsfargo.com"],
    "bankofamerica": ["bankofamerica.com"],
    "revolut": ["revolut.com"],
    "binance": ["binance.com"],
    "coinbase": ["coinbase.com"],
    "metamask": ["metamask.io"],
    "steam": ["steampowered.com", "valvesoftware.com"],
    "ebay": ["ebay.com"],
    "stripe": ["stripe.com"],
    "shopify": ["shopify.com"],
    "booking": ["booking.com"],
    "airbnb": ["airbnb.com"],
    "emirates": ["emirates.com"],
    "etisalat": ["etisalat.ae"],
    "stc": ["stc.com.sa"],
}

# Letters that look like another one, and the letter each looks like.
CONFUSABLE_FROM = "аеорсхуіјѕԁһӏνοαρεικτυ" + "013456789"
CONFUSABLE_TO = "aeopcxyijsdhlvoapeiktu" + "oleasgtbg"

# Public suffixes of two labels.
TWO_LABEL_SUFFIXES = """
co.uk org.uk ac.uk gov.uk net.uk sch.uk me.uk ltd.uk com.au net.au org.au edu.au gov.au id.au
co.nz net.nz org.nz govt.nz ac.nz co.za org.za net.za gov.za ac.za co.jp ne.jp or.jp ac.jp go.jp ad.jp
com.br net.br org.br gov.br edu.br com.cn net.cn org.cn gov.cn edu.cn ac.cn
co.in net.in org.in gen.in firm.in ind.in gov.in com.mx com.ar com.co com.pe com.ve com.ec com.uy
com.sg com.hk com.tw com.my com.ph com.vn com.bd com.tr com.pl com.ua com.ru org.ru net.ru
co.kr or.kr ne.kr go.kr co.il org.il net.il ac.il gov.il co.th in.th ac.th go.th
co.id or.id ac.id go.id web.id com.sa com.eg com.ng com.pk com.kw com.qa co.ke co.tz co.ug
com.es com.pt com.gr com.ro com.hr com.cy
""".split()

# Top-level domains with an abuse problem.
RISKY_TLDS = """
zip mov top xyz gq tk cf ml ga click link live rest country kim work party review trade date wang su
icu cyou sbs buzz monster quest fit casa best autos bond cfd lol makeup skin
""".split()

# URL shorteners.
SHORTENERS = """
bit.ly tinyurl.com t.co goo.gl ow.ly is.gd buff.ly adf.ly j.mp tr.im tiny.cc lnkd.in db.tt qr.ae cur.lv
ity.im q.gs po.st su.pr fire.to bit.do mcaf.ee link.tl go.usa.gov go2.me shorl.com
""".split()

# File endings.
RISKY_EXTENSIONS = "exe scr js hta vbs bat cmd pif msi com dll ps1 sh bash jar app dmg".split()
DOUBLE_EXTENSIONS = "pdf.exe doc.exe xls.exe zip.exe pdf.scr doc.scr xls.scr jpg.exe png.exe gif.exe txt.exe".split()
EXECUTABLE_URL_EXTENSIONS = "exe scr js jar msi vbs hta ps1 bat cmd com pif dll iso img lnk apk dmg jse wsf".split()
ARCHIVE_URL_EXTENSIONS = "zip rar 7z gz tar cab tgz ace".split()

# Free webmail providers.
FREE_MAIL = "gmail.com outlook.com hotmail.com yahoo.com aol.com protonmail.com proton.me gmx.com mail.com yandex.com zoho.com icloud.com".split()

# Weights of indicator types in correlation.
INDICATOR_WEIGHTS = {"hash": 100, "ip": 90, "url": 80, "urlDomain": 70, "from": 65, "replyTo": 60, "domain": 55, "messageIdDomain": 40, "displayName": 35, "subject": 30, "filename": 25, "mailer": 20}

# Points of authentication results, and shares and floors of the score.
SPF_POINTS = {"fail": 30, "softfail": 18, "permerror": 8, "neutral": 5, "none": 5, "temperror": 2, "unknown": 2}
DKIM_POINTS = {"fail": 25, "permerror": 8, "none": 5, "unverified": 4, "unknown": 2}
DMARC_POINTS = {"fail": 35, "none": 5, "unknown": 2}
LANGUAGE_SHARES = {"urgency": 0.5, "authority": 0.5, "financial": 0.8, "credential": 0.8, "bec": 1.0, "lure": 0.6, "advancefee": 0.9, "social": 0.5, "extortion": 1.0}
CATEGORY_WEIGHTS = {"urgency": 1.0, "authority": 1.2, "financial": 1.1, "credential": 1.3, "bec": 1.4, "lure": 1.1, "advancefee": 1.3, "social": 1.0, "extortion": 1.5}
TIER_HIGH, TIER_SUSPICIOUS = 60, 30


# Marker words by language, with the share of a text's words they must exceed.
LANGUAGE_MARKERS = (
    ("en", 0.2, "the and is to of a in that have it for not on with he as you do at this be are was were been will would could should can may might must shall has had did does doing done".split()),
    ("es", 0.25, "el la de que y a en un ser se no haber por con su para como estar tener".split()),
    ("fr", 0.25, "le de et à un il être avoir ne je son que se qui ce dans en du elle au".split()),
    ("de", 0.25, "der die und in den von zu das mit sich des auf für ist im dem nicht ein eine".split()),
)
