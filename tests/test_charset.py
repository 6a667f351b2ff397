import pytest
from pyspark.sql import functions as F

from labelwright.sources import charset

#: None of these sentences is what the tables are made of.
TEXTS = {
    "windows-1250": ["Příliš žluťoučký kůň úpěl ďábelské ódy", "Zażółć gęślą jaźń", "dobrý den, jak se máte", "Árvíztűrő tükörfúrógép", "to jest świetny pomysł", "čeština je těžká"],
    "windows-1251": ["Съешь ещё этих мягких французских булок", "привет", "Москва", "сегодня хорошая погода", "Добрий день"],
    "windows-1253": ["Ξεσκεπάζω την ψυχοφθόρα βδελυγμία", "καλημέρα", "Ελλάδα", "πολύ ωραία μέρα σήμερα"],
    "shift_jis": ["今日はいい天気ですね", "東京", "ありがとう", "日本語のテキスト", "コンピュータを使う"],
    "gb18030": ["今天天气很好", "你好", "北京欢迎你", "这部电影非常好看"],
    "windows-1252": ["“quoted” café €5", "l’été dernier c’était génial", "œuvre à côté"],
    "ISO-8859-1": ["café", "où est la forêt", "schöne Grüße aus München", "el niño comió piña", "não é possível, coração", "rødgrød med fløde", "È più bello così"],
    "UTF-8": ["日本語 café", "plain", ""],
}


@pytest.mark.parametrize("name", TEXTS)
def test_known_texts_are_told(name):
    for text in TEXTS[name]:
        for before in ("", "hello world, "):
            assert charset.detect((before + text).encode("cp1252" if name == "ISO-8859-1" else name)) == (before + text, name)


def test_validity():
    assert charset._double("東京".encode("shift_jis")[:-1], "shift_jis") == float("-inf")
    assert charset.detect(b"caf\xe9 \x81")[0].startswith("caf") and charset.detect(b"\xff\xfe\x80\x81")[1] in {*charset.SENTENCES, *charset.BLOCKS, "ISO-8859-1"}
    for table in charset.tables().values():
        assert (table <= 0).all() and table.shape == (256, 256)


def test_column(spark):
    given = [(n, t) for n, own in TEXTS.items() for t in own]
    rows = [(n, t, t.encode("cp1252" if n == "ISO-8859-1" else n).decode("latin-1")) for n, t in given] + [(None, None, None)]
    got = spark.createDataFrame(rows, "name string, text string, misread string").withColumn("d", charset.detect_text(F.col("misread"))).collect()
    assert [(r.d.encoding, r.d.text) if r.d else (None, None) for r in got] == [(n, t) for n, t, _ in rows]
