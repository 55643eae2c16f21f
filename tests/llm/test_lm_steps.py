import numpy as np
import pytest

from brindle.llm import lm


def test_sums_by_number():
    rng = np.random.default_rng(1)
    for width in (1, 6, 7):
        sums = lm.Sums(50, width, np.dtype(np.float32))
        for _ in range(3):  # one lot leaves nothing to the next
            index = rng.integers(0, 50, 40).astype(np.int32)
            rows = np.zeros((40, width + width % 2), np.float32)
            rows[:, :width] = rng.integers(-9, 9, (40, width))
            where, got = sums.of(index, rows)
            assert where.tolist() == sorted(set(index.tolist()))
            assert all((g == rows[index == w].sum(0)).all() for w, g in zip(where, got))


def plain_steps(p, share, triples, weight, rng, memory, rate, step):
    """The steps of train_nce, written out over all classes."""
    noise_log = np.log(np.maximum(share, 1e-12)) + np.log(lm.NOISE)
    cdf, order = np.cumsum(share), rng.permutation(len(triples))
    for at in range(0, len(order), step):
        far, near, word = triples[order[at : at + step]].T
        w = weight[order[at : at + step]]
        w = w / w.mean() / len(word)
        noise = np.minimum(np.searchsorted(cdf, rng.random(lm.NOISE) * cdf[-1]), len(share) - 1)
        made = p.context[far] * p.scale[0] + p.context[near] * p.scale[1]
        g_word = -w / (1 + np.exp((made * p.target[word]).sum(1) + p.bias[word] - noise_log[word]))
        g_noise = w[:, None] / (1 + np.exp(-(made @ p.target[noise].T + p.bias[noise] - noise_log[noise])))
        g_made = g_word[:, None] * p.target[word] + g_noise @ p.target[noise]
        grads = [np.zeros_like(getattr(p, n)) for n in lm.Params.NAMES]
        np.add.at(grads[0], word, g_word[:, None] * made)
        np.add.at(grads[0], noise, g_noise.T @ made)
        np.add.at(grads[3], word, g_word)
        np.add.at(grads[3], noise, g_noise.sum(0))
        np.add.at(grads[1], far, g_made * p.scale[0])
        np.add.at(grads[1], near, g_made * p.scale[1])
        grads[2] += np.stack([(g_made * p.context[far]).sum(0), (g_made * p.context[near]).sum(0)])
        for k, g in enumerate(grads):
            memory[k] += g * g
            getattr(p, lm.Params.NAMES[k])[...] -= rate * g / np.sqrt(memory[k] + 1e-8)


@pytest.mark.parametrize("width", [5, 8])
def test_steps_are_those_written_out(width):
    """Steps, the last one shorter, with weights that differ, for even and odd widths."""
    share = np.random.default_rng(2).random(30)
    share /= share.sum()
    triples = np.random.default_rng(3).integers(0, 30, (1100, 3)).astype(np.int32)
    weight = np.random.default_rng(4).random(1100) + 0.5
    out = []
    for run in (lm.train_nce, plain_steps):
        p = lm.Params.start(share, width)
        p = lm.Params(*(getattr(p, n).astype(float) for n in lm.Params.NAMES))
        memory = [np.zeros_like(getattr(p, n)) for n in lm.Params.NAMES]
        run(p, share, triples, weight, np.random.default_rng(5), memory, 0.15, 256)
        out.append([*(getattr(p, n) for n in lm.Params.NAMES), *memory])
    for a, b in zip(*out):
        np.testing.assert_allclose(a, b, rtol=1e-9, atol=1e-12)
