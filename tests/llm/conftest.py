import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).parent))

from llm_rows import prose  # noqa: E402


@pytest.fixture(scope="session")
def sample():
    """Rows with every awkward case: nulls, empty and long texts, exact and near copies, repeated rows."""
    base = [prose(i, 80 + 10 * i) for i in range(12)]
    near = base[0].split()
    near[10:12] = ["changed", "words"]
    texts = [*base, base[0], " ".join(near), base[3], None, "", "   ", "word", prose(99, 4000), "ééé " * 60, "a" * 500, base[5] + "\n" + base[5]]
    rows = [(i, t, "en" if i % 3 else "fr", f"s{i % 4}" if i % 5 else None) for i, t in enumerate(texts)]
    return [*rows, rows[2], (None, base[7], None, None)]
