"""A small known world: a quake in many countries, a fire in one, noise; as raw files."""

import zipfile
from datetime import datetime, timedelta

import numpy as np

from newsloom.functions.fixed import EVENT_COLUMNS, GKG_COLUMNS, MENTION_COLUMNS

START = datetime(2023, 2, 6)
SLOTS = 12
MISSING = 9
OUTLETS = [(f"paper{i}.{tld}", code) for i, (tld, code) in enumerate([("co.uk", "UK"), ("de", "GM"), ("fr", "FR"), ("com.tr", "TU"), ("es", "SP"), ("it", "IT"), ("us", "US")] * 3)]


def row(columns, **values):
    return "\t".join(str(values.get(c, "")) for c in columns)


def articles():
    """(story, url, domain, slot, language code or None, title, event, persons, themes, place)"""
    out = []
    for i in range(40):
        domain = OUTLETS[i % len(OUTLETS)][0]
        lang = "tur" if i % 4 == 0 else None
        out.append(("quake", f"https://www.{domain}/world/turkey-earthquake-rescue-{i}.html?utm_source=x", domain, i % 9, lang, f"Earthquake rescue in southern Turkey number {i} | Paper", 100 + i % 3, ["erdogan", "kilicdaroglu"], ["NATURAL_DISASTER_EARTHQUAKE", "CRISISLEX_T03_DEAD"], "4#Gaziantep, Turkey#TU#TU83##37#37#-1"))
    for i in range(15):
        domain = OUTLETS[i % 6][0]
        out.append(("fire", f"https://{domain}/news/chile-wildfire-valparaiso-{i}", domain, 2 + i % 6, None, f"Wildfire near Valparaiso spreads day {i}", 200 + i % 2, ["boric"], ["DISASTER_FIRE", "WILDFIRE"], "4#Valparaiso, Chile#CI#CI01##-33#-71#-2"))
    for i in range(6):
        out.append((f"noise{i}", f"https://solo{i}.com/misc/{'abcdef'[i] * 5}-{'uvwxyz'[i] * 6}", f"solo{i}.com", i, None, f"{'Quiet Odd Plain Dull Grey Flat'.split()[i]} {'garden market recipe chess opera ferry'.split()[i]} column", 300 + i, [f"person{i}"], [f"THEME_{i}"], ""))
    return out


def write_raw(folder):
    folder.mkdir(parents=True, exist_ok=True)
    files = {}
    for n, (_, url, domain, slot, lang, title, event, persons, themes, place) in enumerate(articles()):
        at = START + timedelta(minutes=15 * slot)
        stamp, info = at.strftime("%Y%m%d%H%M%S"), f"srclc:{lang};eng:GT" if lang else ""
        family = "translation." if lang else ""
        extras = f"<PAGE_TITLE>{title} &amp; more</PAGE_TITLE>" if n != 7 else ""
        gkg = row(GKG_COLUMNS, GKGRecordID=f"{stamp}-{n}", Date=stamp, SourceCollectionIdentifier=1, SourceCommonName=domain, DocumentIdentifier=url, Themes=";".join(themes), V2Locations=place and place + ";1#Turkey#TU#TU##39#35#T", Persons=";".join(persons), Organizations="un;red cross", V2Tone="-5.2,1.1,6.3,7.4,20,0,300", TranslationInfo=info, Extras=extras)
        mention = row(MENTION_COLUMNS, GlobalEventID=event, EventTimeDate=stamp, MentionTimeDate=stamp, MentionType=1, MentionSourceName=domain, MentionIdentifier=url, SentenceID=1, InRawText=1, Confidence=80, MentionDocLen=900, MentionDocTone=-3.5, MentionDocTranslationInfo=info)
        files.setdefault((slot, f"{family}gkg.csv"), []).append(gkg)
        files.setdefault((slot, f"{family}mentions.CSV"), []).append(mention)
    # one page in both families; the English record counts
    url = articles()[1][1]
    files[0, "translation.gkg.csv"] = files.get((0, "translation.gkg.csv"), []) + [row(GKG_COLUMNS, GKGRecordID="t", Date=(START + timedelta(minutes=15)).strftime("%Y%m%d%H%M%S"), DocumentIdentifier=url, TranslationInfo="srclc:deu", SourceCommonName="x")]
    files[1, "mentions.CSV"].append("only\ttwo")
    for e, (name, code, root, country) in {**{100 + i: ("TURKEY", "TU", "07", "TU") for i in range(3)}, **{200 + i: ("CHILE", "CI", "02", "CI") for i in range(2)}, **{300 + i: ("X", "US", "01", "") for i in range(6)}}.items():
        files.setdefault((0, "export.CSV"), []).append(row(EVENT_COLUMNS, GlobalEventID=e, Day=20230206, Year=2023, Actor1Name=name, EventCode=root + "1", EventBaseCode=root + "1", EventRootCode=root, QuadClass=2, GoldsteinScale=7, NumMentions=10, NumSources=2, NumArticles=9, AvgTone=-4, ActionGeo_Type=4, ActionGeo_FullName=f"{name} place", ActionGeo_CountryCode=country, ActionGeo_Lat=37, ActionGeo_Long=36, DATEADDED=START.strftime("%Y%m%d%H%M%S"), SOURCEURL=url))
    for slot in range(SLOTS):
        for kind in ("gkg.csv", "translation.gkg.csv", "mentions.CSV", "translation.mentions.CSV", "export.CSV", "translation.export.CSV"):
            if slot == MISSING and kind == "mentions.CSV":
                continue
            name = f"{(START + timedelta(minutes=15 * slot)):%Y%m%d%H%M%S}.{kind}"
            body = "".join(x + "\n" for x in files.get((slot, kind), []))
            if slot == 11:
                (folder / name.lower()).write_text(body, encoding="utf-8")
            else:
                with zipfile.ZipFile(folder / f"{name}.zip", "w") as z:
                    z.writestr(name, body)


def write_lookup(path):
    path.write_text("www.paper0.co.uk\tXX\tOld\n" + "".join(f"{d}\t{c}\tCountry {c}\n" for d, c in OUTLETS if not d.startswith("paper1.")) + "de\t\tnone\nshort\n", encoding="utf-8")


def vectors(documents):
    """(document_id, vector): a direction a story and noise around it."""
    rng = np.random.default_rng(7)
    anchors = {}
    out = []
    for r in sorted(documents, key=lambda r: r["canonical_url"]):
        if r["title"] is None:
            continue
        story = "quake" if "earthquake" in r["canonical_url"] else "fire" if "wildfire" in r["canonical_url"] else r["canonical_url"]
        base = anchors.setdefault(story, rng.normal(size=16))
        v = base / np.linalg.norm(base) + 0.15 * rng.normal(size=16)
        out.append((r["document_id"], (v / np.linalg.norm(v)).tolist()))
    return out
