import os
import random

import numpy as np
import pytest

from signalpanel.llm.columns import Collection


def common(a, b):
    return len(os.path.commonprefix([a, b]))


@pytest.mark.parametrize("block", [1 << 18, 5, 64])
def test_equals_sorted_suffixes(tmp_path, block):
    r = random.Random(block)
    for turn in range(25):
        texts = [bytes(r.choice(b"ab" if turn % 2 else b"abcdef") for _ in range(r.randrange(0, 30))) for _ in range(r.randrange(1, 12))]
        texts += [texts[0]] * (turn % 3)
        c = Collection(texts, str(tmp_path), block).build()
        bwt, lcp, own = (np.concatenate([*x.blocks(block)]) for x in c.columns)
        suffix = [texts[o >> 8][o & 255 :] for o in own.tolist()]
        assert sorted(own.tolist()) == sorted(i << 8 | k for i, t in enumerate(texts) for k in range(len(t) + 1))
        assert suffix == sorted(suffix)
        assert lcp.tolist() == [0, *(common(a, b) for a, b in zip(suffix, suffix[1:]))]
        assert bwt.tolist() == [texts[o >> 8][(o & 255) - 1] + 1 if o & 255 else 0 for o in own.tolist()]
        text, start, group = c.repeats(4)
        heads = {}
        for i, t in enumerate(texts):
            for k in range(len(t) - 3):
                heads.setdefault(t[k : k + 4], set()).add((i, k))
        want = {frozenset(v) for v in heads.values() if len(v) > 1}
        got = {}
        for i, k, g in zip(text.tolist(), start.tolist(), group.tolist()):
            got.setdefault(g, set()).add((i, k))
        assert {frozenset(v) for v in got.values()} == want
