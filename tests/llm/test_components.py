import random

from calibra.llm import components
from calibra.llm.components import connected_components


def test_chain_ends_in_few_rounds_and_join_rows(spark, monkeypatch):
    """Labels that go from link to link take a round for each two links of a chain; here a round has fewer links than the one before."""
    rnd = random.Random(1)
    names = rnd.sample(range(10_000), 400)
    pairs = [(names[i], names[i + 1]) for i in range(299)] + [(names[300], x) for x in names[301:360]] + [(5, 5)]
    sizes = []

    def counted(df, name):
        out = kept(df, name)
        if name == "edges":
            sizes.append(out.count())
        return out

    kept = components.saved
    monkeypatch.setattr(components, "saved", counted)
    got = {r.id: r.component for r in connected_components(spark.createDataFrame(pairs + [(b, a) for a, b in pairs], "a long, b long")).collect()}
    assert got == {x: min(names[:300]) for x in names[:300]} | {x: min(names[300:360]) for x in names[300:360]}
    assert sizes[0] == 358 and all(2 * y <= x for x, y in zip(sizes, sizes[1:]))
    assert connected_components(spark.createDataFrame([], "a long, b long")).count() == 0
