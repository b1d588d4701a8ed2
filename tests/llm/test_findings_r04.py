import random

from scanlytics.llm import jaccard_join

from test_jaccard_join import brute, near_copies, ours


def test_sets_in_many_large_regions_are_filled_once(spark, monkeypatch):
    """texts of common lines meet in many large regions; only those with a near one get their sets, once each."""
    monkeypatch.setattr(jaccard_join, "REGION", 16)
    rng = random.Random(2)
    lines = [" ".join(f"line{j}word{i}" for i in range(12)) for j in range(6)]
    texts = [" ".join(rng.sample(lines, 3) + [f"own{i}word{w}" for w in range(rng.randrange(4, 9))]) for i in range(240)]
    rows = list(enumerate(texts + near_copies(rng, 60, 80, (0, 3))))
    seen: dict = {}

    def counted(df, label):
        table = made(df, label)
        seen.setdefault(label, []).append(table.count())
        return table

    made = jaccard_join.written
    monkeypatch.setattr(jaccard_join, "written", counted)
    assert ours(spark, rows, 3, 90) == brute(rows, 3, 90)
    assert seen["filled"] and max(seen["filled"]) <= 90
