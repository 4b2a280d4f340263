"""The removal of passages with more test windows than a task may hold gives what the broadcast gives."""

from test_operators import BASE, ITEMS, SCHEMA, TEXTS

from vigilake.llm import decontaminate


def test_cut_by_join(spark):
    own = " ".join(f"own{i}" for i in range(40))
    # a passage at the end of own words, one around another, which only shows after a cut, and one that is too much of its text
    texts = [*TEXTS, (20, own + " Three, four " + BASE[14:] + ".", "s", "en"), (21, own + " a three four five six seven eight nine ten eleven twelve b c, " + own, "s", "en"), (22, own, "s", "en")]
    docs, items = spark.createDataFrame(texts, SCHEMA), spark.createDataFrame([*ITEMS, (7, "a b c")], "item_id long, text string")
    held, joined = (sorted(repr(tuple(r)) for r in decontaminate.decontaminate(docs, items, most=most).collect()) for most in (decontaminate.HELD_WINDOWS, 0))
    assert held == joined and any("own0" in x for x in joined)
