"""Items that repeat a short run, and documents that repeat a passage."""

from almanac.llm import decontaminate


def test_every_copy_of_a_passage_may_serve_a_tile():
    x = [f"x{k}" for k in range(5)]
    part = [f"a{k}" for k in range(12)] + x + [f"b{k}" for k in range(13)]
    rest = [w for k in range(8) for w in [*x, f"f{k}0", f"f{k}1", f"f{k}2", f"f{k}3"][: 9 if k < 6 else 8]]
    item = part + rest
    assert len(item) == 100
    document = [w for k in range(9) for w in [*part, f"g{k}"]]
    seeds = decontaminate.Seeds([(0, " ".join(item))])
    assert seeds.coverage(document) == {0: 0.7}
    assert sum(n for _, _, n in decontaminate.tiles(item, document)) == 70
