"""Kernels over sorted rows that arrive in Arrow batches: long convolutions by overlap-save, and exponential averages by a scan.

Both see the rows of one task in order, many series one after another, and carry from batch to batch what the next one needs: the last K - 1
values of a kernel of K weights, or the last average.
"""

from __future__ import annotations

import numpy as np


class OverlapSave:
    """y[t] = sum of kernel[k] * x[t - k] over a stream in batches of any length, by transforms of fixed size.

    A transform covers size values, K - 1 of which came before; the others' sums are whole. So a value costs about log K and nothing is held but
    the last K - 1 values. Sums reach back over the beginning of a series: the caller leaves out the K - 1 values that follow one, and
    with them every sum that mixes two series. A value that is missing makes NaN of the sums whose weight for it is not zero, an infinite one what
    arithmetic makes of it; neither reaches others of its transform.
    """

    def __init__(self, kernel: np.ndarray) -> None:
        self.kernel = np.asarray(kernel, float)
        self.last = len(self.kernel) - 1
        self.size = 1 << max(12, (4 * len(self.kernel) - 1).bit_length())
        self.spectrum = np.fft.rfft(self.kernel, self.size)
        self.used = np.fft.rfft((self.kernel != 0).astype(float), self.size)
        self.before = np.zeros(self.last)
        self.transforms = 0

    def _sums(self, x: np.ndarray, spectrum: np.ndarray) -> np.ndarray:
        """The sums of all but the first K - 1 of x."""
        step = self.size - self.last
        out = np.empty(len(x) - self.last)
        for at in range(0, len(out), step):
            part = x[at : at + self.size]
            self.transforms += 1
            whole = np.fft.irfft(np.fft.rfft(part, self.size) * spectrum, self.size)
            out[at : at + step] = whole[self.last : len(part)]
        return out

    def push(self, x: np.ndarray) -> np.ndarray:
        """The sums of the next values."""
        if not len(x):
            return np.empty(0)
        x = np.concatenate([self.before, x])
        good = np.isfinite(x)
        # sums of what is left over the mean are rounded at the scale of the differences, not of the values
        level = float(x[good].mean()) if good.any() else 0.0
        out = self._sums(np.where(good, x - level, 0.0), self.spectrum) + level * self.kernel.sum()
        if not good.all():
            gone, endless = (self._sums(v.astype(float), self.used) > 0.5 for v in (np.isnan(x), np.isinf(x)))
            out[gone] = np.nan
            for i in np.flatnonzero(endless & ~gone).tolist():
                out[i] = sum_of(x[i : i + self.last + 1][::-1], self.kernel)
        self.before = x[len(x) - self.last :] if self.last else self.before
        return out


def sum_of(window: np.ndarray, kernel: np.ndarray) -> float:
    """One sum, by arithmetic: weights that are zero read nothing."""
    on = kernel != 0
    with np.errstate(all="ignore"):
        return float(window[on] @ kernel[on])


class Averages:
    """y[t] = a * x[t] + (1 - a) * y[t - 1] within each series, y = x at its first row; a batch at a time.

    The recurrence is a product of maps y -> m * y + b, so log n steps over whole arrays give all values of a batch; a series' first row has m = 0 and
    cuts it from the one before. A missing value makes its series missing from there on.
    """

    def __init__(self, a: float) -> None:
        self.a, self.held = a, float("nan")

    def push(self, x: np.ndarray, first: np.ndarray, hand_over: dict[int, float] | None = None) -> np.ndarray:
        """The averages of the next rows; first: where a series begins; hand_over: the average before the rows of these numbers, where a series goes on there."""
        n = len(x)
        if not n:
            return np.empty(0)
        x = np.asarray(x, float)
        m, b = np.full(n, 1 - self.a), self.a * x
        m[first], b[first] = 0.0, x[first]
        before = {0: self.held} if not first[0] else {}
        starts = np.array(first, bool)
        for row, value in (before | (hand_over or {})).items():
            b[row], m[row], starts[row] = self.a * x[row] + (1 - self.a) * value, 0.0, True
        if np.isinf(b).any():
            return self._by_rows(m, b, starts)
        begin = np.maximum.accumulate(np.where(starts, np.arange(n), 0))
        missing = np.isnan(b)
        gone = np.maximum.accumulate(np.where(missing, np.arange(n), -1)) >= begin
        b = np.where(missing, 0.0, b)
        reach, longest = 1, int((np.arange(n) - begin).max()) + 1
        while reach < longest:
            b[reach:] = b[reach:] + m[reach:] * b[:-reach]
            m[reach:] = m[reach:] * m[:-reach]
            reach *= 2
        b[gone] = np.nan
        self.held = float(b[-1])
        return b

    def _by_rows(self, m: np.ndarray, b: np.ndarray, starts: np.ndarray) -> np.ndarray:
        y = 0.0
        for i in range(len(b)):
            y = b[i] if starts[i] else m[i] * y + b[i]
            b[i] = y
        self.held = float(b[-1])
        return b


__all__ = ["Averages", "OverlapSave", "sum_of"]
