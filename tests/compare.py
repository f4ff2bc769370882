"""Compares two results as the rows of text they hold, columns by name, in any order."""

SF = "/root/testdata/sf0.001"


def rows(frame) -> tuple[list[str], list[tuple[str, ...]]]:
    frame = frame[sorted(frame.columns)]
    text = frame.astype(object).where(frame.notna(), None)
    return list(frame.columns), sorted(tuple(str(x) for x in r) for r in text.itertuples(index=False))


def same(a, b) -> None:
    (ca, ra), (cb, rb) = rows(a), rows(b)
    assert ca == cb
    assert len(ra) == len(rb)
    assert ra == rb
