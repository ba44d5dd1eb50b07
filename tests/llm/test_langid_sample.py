"""The sample that language ID learns from keeps every language, whatever the lengths of the texts."""

from sparkloom.llm import langid

WORDS = {"de": "das haus und der baum ", "en": "the house and the tree ", "ru": "дом и дерево стоят "}


def test_long_texts_do_not_end_the_sample(spark):
    short = [(i, WORDS[lang], lang) for i, lang in enumerate(["de", "en", "ru"] * 30)]
    long = [(1000 + i, WORDS["en"] * 1000, "en") for i in range(100)]
    for rows in (short + long, short + long + [(5000 + i, WORDS["de"] * 100, "de") for i in range(100)]):
        m = langid.fit(spark.createDataFrame(rows, "doc_id long, text string, lang string"), max_chars=6000)
        assert m.languages == ["de", "en", "ru"]
        assert [x for x, _ in m.predict([*WORDS.values()])] == ["de", "en", "ru"]


def test_shares_of_the_budget():
    sizes = [("a", 50), ("b", 10), ("a", 30), ("c", 500), ("b", 10), ("a", 40), ("c", 400)]
    assert langid.within(sizes, 10**6) == list(range(7))
    # b leaves 20 of its 40; a takes 50 of 50 and then nothing fits; c has no text that fits and gives its shortest
    assert langid.within(sizes, 120) == [0, 1, 4, 6]
    assert langid.within([], 10) == []
