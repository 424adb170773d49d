"""What a worker gives back when another operator takes it over."""

import ctypes

import numpy as np
import psutil
import pytest

from quillspark.llm import common


@pytest.mark.skipif(not hasattr(ctypes.CDLL(None), "malloc_trim"), reason="glibc only")
def test_free_memory_goes_back():
    held = [np.ones(4000) for _ in range(10000)]
    kept = held[::1000]
    full = psutil.Process().memory_info().rss
    del held
    common.takes_over("another operator")
    assert len(kept) == 10 and full - psutil.Process().memory_info().rss > 200e6
