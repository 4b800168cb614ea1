"""What may reach the driver, and what may not be used at all."""

import re
from pathlib import Path

ROOT = Path(__file__).resolve().parents[2]
# The counts table and the bitmap (fixed sizes), counts by length (capacity), weights (2^20 places), frequent words (FREQUENT).
BOUNDED = {"jaccard_join.py": 2, "packing.py": 1, "toxicity.py": 1, "bpe_fold.py": 1}


def test_nothing_unbounded_reaches_the_driver():
    files = [*(ROOT / "querymill" / "llm").glob("*.py"), ROOT / "corpus_pipeline.py"]
    found = {p.name: len(re.findall(r"\.(?:collect|toPandas|toLocalIterator)\(", p.read_text())) for p in files}
    assert {k: v for k, v in found.items() if v} == BOUNDED
    text = "".join(p.read_text() for p in files)
    assert not re.search(r"localCheckpoint|crossJoin|\.rdd\b|tempfile|mkdtemp", text)


def test_native_operators_use_no_python_on_rows():
    for name in ("url_filters", "chat_format", "winnowing", "bpe_fold"):
        text = (ROOT / "querymill" / "llm" / f"{name}.py").read_text()
        assert not re.search(r"pandas|[aA]rrow|F\.udf|mapIn|applyIn", text), name
