"""Which encoding a text's bytes are in, by what each would make of them.

An encoding that can't have these bytes is out. A code page of single bytes is a table of how likely each byte follows another, counted on a
few sentences in languages that are written in it; in encodings of two bytes a character is as likely as its block. The encoding
under which the bytes are likeliest is taken; pairs of plain ASCII are the same in all of them and don't count.
"""

from __future__ import annotations

import unicodedata
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

#: The first article of the Universal Declaration of Human Rights, by code page.
SENTENCES = {
    "windows-1252": (
        "All human beings are born free and equal in dignity and rights. They are endowed with reason and conscience and should act towards one another in a spirit of brotherhood.",
        "Tous les êtres humains naissent libres et égaux en dignité et en droits. Ils sont doués de raison et de conscience et doivent agir les uns envers les autres dans un esprit de fraternité. C’est ça, à côté où naïve forêt. Déjà là, voilà.",
        "Alle Menschen sind frei und gleich an Würde und Rechten geboren. Sie sind mit Vernunft und Gewissen begabt und sollen einander im Geiste der Brüderlichkeit begegnen. Größe, schön, Mädchen, für.",
        "Todos los seres humanos nacen libres e iguales en dignidad y derechos y, dotados como están de razón y conciencia, deben comportarse fraternalmente los unos con los otros. ¿Qué? Año, así, también.",
        "Todos os seres humanos nascem livres e iguais em dignidade e em direitos. Dotados de razão e de consciência, devem agir uns para com os outros em espírito de fraternidade. Não, ações, você, à.",
        "Tutti gli esseri umani nascono liberi ed eguali in dignità e diritti. Essi sono dotati di ragione e di coscienza e devono agire gli uni verso gli altri in spirito di fratellanza. Perché, è, più, così.",
        "Alle mennesker er født frie og lige i værdighed og rettigheder. De er udstyret med fornuft og samvittighed, og de bør handle mod hverandre i en broderskabets ånd. Også, små, blåbær, køb, Ø, Økonomi, øl.",
        "Alla människor är födda fria och lika i värde och rättigheter. De är utrustade med förnuft och samvete och bör handla gentemot varandra i en anda av broderskap. Också, på, från, får.",
    ),
    "windows-1250": (
        "Wszyscy ludzie rodzą się wolni i równi pod względem swej godności i swych praw. Są oni obdarzeni rozumem i sumieniem i powinni postępować wobec innych w duchu braterstwa. Był, już, także, można, źle, jeśli, dzień, świat, śmierć, środa.",
        "Všichni lidé rodí se svobodní a sobě rovní co do důstojnosti a práv. Jsou nadáni rozumem a svědomím a mají spolu jednat v duchu bratrství. Ještě, který, při, může, tři, řekl, dobře, více, č, být, všechny.",
        "Minden emberi lény szabadon születik és egyenlő méltósága és joga van. Az emberek, ésszel és lelkiismerettel bírván, egymással szemben testvéri szellemben kell hogy viseltessenek. Nő, első, jövő, űr, gyűlés, időben.",
        "Sva ljudska bića rađaju se slobodna i jednaka u dostojanstvu i pravima. Ona su obdarena razumom i sviješću i trebaju jedna prema drugima postupati u duhu bratstva. Već, kuća, što, može, čovjek, također.",
        "Všetci ľudia sa rodia slobodní a rovní v dôstojnosti aj právach. Sú obdarení rozumom a svedomím a majú sa k sebe správať v duchu bratstva. Veľmi, ktorý, pôjdem, že, čo.",
    ),
    "windows-1251": (
        "Все люди рождаются свободными и равными в своем достоинстве и правах. Они наделены разумом и совестью и должны поступать в отношении друг друга в духе братства. Это, ещё, что, чтобы, быть, уже, объект.",
        "Всі люди народжуються вільними і рівними у своїй гідності та правах. Вони наділені розумом і совістю і повинні діяти у відношенні один до одного в дусі братерства. Є, її, ґанок.",
        "Всички хора се раждат свободни и равни по достойнство и права. Те са надарени с разум и съвест и следва да се отнасят помежду си в дух на братство.",
    ),
    "windows-1253": (
        "Όλοι οι άνθρωποι γεννιούνται ελεύθεροι και ίσοι στην αξιοπρέπεια και τα δικαιώματα. Είναι προικισμένοι με λογική και συνείδηση, και οφείλουν να συμπεριφέρονται μεταξύ τους με πνεύμα αδελφοσύνης. Ή, ώρα, ύστερα, ζωή, ψυχή, βάζω, χώρα, το, του, της, μου.",
    ),
}
#: Shares of blocks of two-byte encodings, as (first lead byte, last lead byte, share). A lead byte of one byte stands for itself.
BLOCKS = {
    "shift_jis": ((0x81, 0x81, 0.09), (0x82, 0x82, 0.45), (0x83, 0x83, 0.12), (0x84, 0x87, 0.001), (0x88, 0x97, 0.32), (0x98, 0xEA, 0.01), (0xED, 0xFC, 0.0002), (0xA1, 0xDF, 0.002)),
    "gb18030": ((0xA1, 0xA1, 0.03), (0xA2, 0xA2, 0.001), (0xA3, 0xA3, 0.06), (0xA4, 0xA9, 0.002), (0xB0, 0xD7, 0.87), (0xD8, 0xF7, 0.03), (0x81, 0xA0, 0.0005), (0xAA, 0xAF, 0.0002), (0xF8, 0xFE, 0.0002)),
}
#: Parts of a following byte's likelihood: seen behind this byte, seen at all, its kind.
WEIGHTS = (0.6, 0.3, 0.1)
#: What the commonest code page has ahead of the others (a logarithm).
AHEAD = {"windows-1252": 1.0}
#: How much less likely a Latin letter is beside one of another script, and a character of two bytes beside it or with a second byte below the usual.
MIXED, BESIDE, RARE = 1e-4, 0.05, 1e-3
OUT = -1e6


def _kinds(page: str) -> np.ndarray:
    """Shares of the 256 bytes by what they are in the page: a letter, a mark, a control; none where there is no character."""
    share = np.zeros(256)
    for b in range(256):
        c = bytes([b]).decode(page, "ignore")
        if c:
            kind = unicodedata.category(c)
            share[b] = 1.0 if kind[0] == "L" else 0.5 if c in " .,-'" else 0.05 if kind[0] in "PSNZM" else 0.001
            if b >= 0x80 and kind[0] == "L" and c.isupper():
                share[b] = 0.1
    return share / share.sum()


@lru_cache(maxsize=1)
def tables() -> dict[str, np.ndarray]:
    """log P(next byte | byte) of each single-byte page."""
    made = {}
    for page, sentences in SENTENCES.items():
        pairs = np.zeros((256, 256))
        for sentence in sentences:
            for text, weight in ((f" {sentence} ", 1.0), (f" {sentence.upper()} ", 0.05)):
                raw = np.frombuffer(text.encode(page, "ignore"), np.uint8)
                np.add.at(pairs, (raw[:-1], raw[1:]), weight)
        single, kinds = pairs.sum(0) / pairs.sum(), _kinds(page)
        behind = pairs / np.maximum(pairs.sum(1, keepdims=True), 3.0)  # bytes seldom seen say little of what follows
        a, b, c = WEIGHTS
        likely = a * behind + b * single + c * kinds
        likely[:, kinds == 0] = 0
        # Letters of another script than Latin don't stand beside Latin ones in a word.
        names = [unicodedata.name(bytes([b]).decode(page, "ignore") or " ", "") for b in range(256)]
        latin, other = (np.array([test(n) for n in names]) for test in (lambda n: n.startswith("LATIN"), lambda n: " LETTER " in n and not n.startswith("LATIN")))
        likely[np.ix_(latin, other)] *= MIXED
        likely[np.ix_(other, latin)] *= MIXED
        with np.errstate(divide="ignore"):
            made[page] = np.where(likely > 0, np.log(np.maximum(likely, 1e-300)), OUT)
    return made


def _single(raw: np.ndarray, table: np.ndarray) -> float:
    data = np.concatenate([[32], raw, [32]])
    high = (data[:-1] >= 0x80) | (data[1:] >= 0x80)
    return float(table[data[:-1][high], data[1:][high]].sum())


def _double(data: bytes, name: str) -> float:
    """Likelihood of the characters above ASCII, each its block's share over the block's size."""
    try:
        data.decode(name)
    except UnicodeDecodeError:
        return -np.inf
    total, i = 0.0, 0
    alone = range(0xA1, 0xE0) if name == "shift_jis" else ()
    while i < len(data):
        b = data[i]
        if b < 0x80:
            i += 1
            continue
        low, high, share = next((x for x in BLOCKS[name] if x[0] <= b <= x[1]), (b, b, 1e-6))
        one, four = b in alone, name == "gb18030" and i + 1 < len(data) and 0x30 <= data[i + 1] <= 0x39
        if name == "gb18030" and not four and data[i + 1] < 0xA1:
            share *= RARE
        if i and data[i - 1] < 0x80 and chr(data[i - 1]).isalpha():
            share *= BESIDE
        i += 1 if one else 4 if four else 2
        if i < len(data) and data[i] < 0x80 and chr(data[i]).isalpha():
            share *= BESIDE
        total += np.log(1e-9 if four else share / ((high - low + 1) * (1 if one else 94)))
    return total


def detect(data: bytes) -> tuple[str, str]:
    """(text, encoding) of bytes: UTF-8 where they are valid, else the likeliest; the order of ``SENTENCES`` and ``BLOCKS`` decides ties.

    Windows-1252 without a byte from 0x80 to 0x9F is called ISO-8859-1. Bytes that even the best encoding hasn't become U+FFFD.
    """
    try:
        return data.decode("utf-8"), "UTF-8"
    except UnicodeDecodeError:
        raw = np.frombuffer(data, np.uint8)
    scores = {page: AHEAD.get(page, 0.0) + _single(raw, table) for page, table in tables().items()} | {name: _double(data, name) for name in BLOCKS}
    best = max(scores, key=scores.__getitem__)
    if best == "windows-1252":
        shown = "".join(bytes([b]).decode("cp1252", "ignore") or chr(b) for b in data) if (raw >= 0x80).any() else data.decode("ascii")
        return shown, best if ((raw >= 0x80) & (raw < 0xA0)).any() else "ISO-8859-1"
    return data.decode(best, "replace"), best


FOUND = StructType([StructField("text", StringType()), StructField("encoding", StringType())])


@F.pandas_udf(FOUND)
def _detected(data: pd.Series) -> pd.DataFrame:
    known: dict[bytes, tuple[str, str]] = {}
    found = [(None, None) if x is None else known.get(x) or known.setdefault(x, detect(x)) for x in data]
    return pd.DataFrame(found, columns=["text", "encoding"])


def detect_text(column: Column) -> Column:
    """struct(text, encoding) of bytes, or of text that was read as ISO-8859-1, by ``detect``; null stays null.

    Bytes that are valid UTF-8 are decoded where they are; only others go to Python.
    """
    data = F.encode(column, "ISO-8859-1")
    valid = F.is_valid_utf8(data.cast("string"))
    found = _detected(F.when(~valid, data))
    plain = F.struct(F.decode(data, "UTF-8").alias("text"), F.lit("UTF-8").alias("encoding"))
    return F.when(valid, plain).when(valid.isNotNull(), found)
