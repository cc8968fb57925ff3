import numpy as np

from tabularium.llm import common

U = np.uint64


def plain_hash(values, a, b, salt):
    h = 0
    for i, v in enumerate(values[a:b].tolist()):
        h = (h + v * pow(common._BASE, i, 1 << 64)) % (1 << 64)
    return int(common.mix(np.array([(h + (b - a) * 0xC2B2AE3D27D4EB4F + salt) % (1 << 64)], U))[0])


def test_runs_across_steps(monkeypatch):
    monkeypatch.setattr(common, "_STEP", 16)
    common._powers.cache_clear()
    rng = np.random.default_rng(3)
    values = rng.integers(1, 1 << 63, 200, dtype=np.int64).astype(U)
    starts = np.sort(rng.integers(0, 200, 60))
    ends = np.minimum(200, starts + rng.integers(0, 70, 60))
    for order in (np.arange(60), rng.permutation(60)):  # in order of place, and not
        got = common.runs_hash(values, starts[order], ends[order], 9)
        assert got.tolist() == [plain_hash(values, int(a), int(b), 9) for a, b in zip(starts[order], ends[order], strict=True)]
    common._powers.cache_clear()
