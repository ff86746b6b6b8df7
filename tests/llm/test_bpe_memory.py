"""What a codec has freed is not kept by its allocators."""

import subprocess
import sys
from pathlib import Path

CODE = """
import gc, random
from colprov.llm import bpe

def held():
    gc.collect()
    return next(int(x.split()[1]) for x in open("/proc/self/smaps_rollup") if x.startswith("Pss_Anon")) >> 10

content, _ = bpe.public_vocabulary()
codec = bpe.Codec(bpe.read_ranks(content))
rng = random.Random(5)
letters = "abcdefghijklmnopqrstuvwxyz"
words = ["".join(rng.choices(letters, k=rng.randint(20, 40))) for _ in range(20_000)]
codec.learn(words[:10])
before = held()
codec.learn(words)
assert len(codec.known) == len(set(words))
print(held() - before)
"""


def test_memory_of_a_query_goes_back():
    """20,000 words and their ids take about 8 MB; the query that finds them works in far more."""
    root = Path(__file__).resolve().parents[2]
    out = subprocess.run([sys.executable, "-c", CODE], cwd=root, capture_output=True, text=True, check=True, timeout=120)
    assert int(out.stdout) < 90, out.stdout
