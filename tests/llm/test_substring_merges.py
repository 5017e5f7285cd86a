"""What op9's merges look at, and what they leave as it stands."""

import numpy as np

from strophe.llm import substrings as S


def blobs_of(texts: dict[int, bytes], bucket: int, levels: S.Levels) -> list[bytes]:
    made = S.Bucket(np.array(list(texts)), list(texts.values()), bucket)
    anchors = made.run[0]
    part, short = S.short_of(anchors, 1)
    keys = np.unique(short).astype(np.uint32)
    return [b for place, b in made.blobs({0: (keys, np.zeros(len(keys), dtype=bool))}, 1, levels) if place >= 0]


def text(seed: int, size: int = 400) -> bytes:
    return bytes(np.random.default_rng(seed).integers(97, 123, size, dtype=np.uint8))


def test_only_anchors_of_several_runs_are_merged(monkeypatch):
    """Entries that one run alone has pass a level as they stand, in their order, with their texts."""
    levels = S.Levels(4, 1)
    common = text(0, 150)
    blobs = blobs_of({1: text(1), 2: text(2) + common}, 0, levels) + blobs_of({3: text(3), 4: common + text(4)}, 1, levels)
    before = [list(r.only(np.unique(r.entries["anchor"]))) for r in S.opened(blobs)]
    looked: list[int] = []
    whole = S.equal_texts

    def counted(runs, wanted):
        for key, since, members in whole(runs, wanted):
            looked.append(len(members))
            yield key, since, members

    monkeypatch.setattr(S, "equal_texts", counted)
    made = [b for key, b in S.joined_runs(blobs, 0, 1, levels) if key >= 0]
    after = [(now, r.docs["id"][doc], at, starts) for r in S.opened(made) for now, _, doc, at, starts in r.only(np.unique(r.entries["anchor"]))]
    keys = {now for rows in before for now, *_ in rows}
    assert 0 < sum(looked) < 40 < sum(map(len, before))
    assert {now for now, *_ in after} == keys and [a[0] for a in after] == sorted(keys)


def test_two_texts_without_a_common_string_are_not_taken_apart(monkeypatch):
    """Texts that share an anchor by chance are told apart by a look; those that share a string are not."""
    monkeypatch.setattr(S, "keepers", lambda group: 1 / 0)
    a, b = text(5, 60), text(6, 60)
    out: list = []
    S.spans_of([(bytes(8) + a, 0, [(1, 0, 0, 0, 11)]), (bytes(8) + b, 8, [(2, 0, 1, 0, 11), (3, 1, 0, 7, 11)])], out)
    assert out == [(1, 0, 7, 67)]
    monkeypatch.undo()
    for shift in range(12):
        other = text(7, shift) + a[: 60 - shift]
        S.spans_of([(bytes(8) + a, 0, [(1, 0, 0, 0, 11)]), (bytes(8) + other, 8, [(2, 0, 1, 0, 11)])], out := [])
        assert out == ([(0, 1, shift, 60)] if shift <= 10 else [])
