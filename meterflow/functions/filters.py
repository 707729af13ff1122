"""Digital filters as second-order sections: four families, each low-, high-, band-pass and band-stop.

A family gives an analogue prototype of unit cut-off (zeros, poles, gain); one set of transformations serves them all."""

from __future__ import annotations

import numpy as np

Zpk = tuple[np.ndarray, np.ndarray, float]


def _gain_at_zero(z: np.ndarray, p: np.ndarray, value: float = 1.0) -> float:
    return value * float(np.real(np.prod(-p) / np.prod(-z)))


def _butterworth(order: int) -> Zpk:
    m = np.arange(-order + 1, order, 2)
    return np.zeros(0, complex), -np.exp(1j * np.pi * m / (2 * order)), 1.0


def _chebyshev_1(order: int, ripple: float) -> Zpk:
    eps = np.sqrt(10 ** (ripple / 10) - 1)
    p = -np.sinh(np.arcsinh(1 / eps) / order + 1j * np.pi * np.arange(-order + 1, order, 2) / (2 * order))
    z = np.zeros(0, complex)
    return z, p, _gain_at_zero(z, p, 1.0 if order % 2 else 10 ** (-ripple / 20))


def _chebyshev_2(order: int, attenuation: float) -> Zpk:
    mu = np.arcsinh(np.sqrt(10 ** (attenuation / 10) - 1)) / order
    m = np.arange(-order + 1, order, 2)
    p = 1 / -(np.sinh(mu) * np.cos(np.pi * m / (2 * order)) + 1j * np.cosh(mu) * np.sin(np.pi * m / (2 * order)))
    z = 1j / np.sin(np.pi * m[m != 0] / (2 * order))
    return z, p, _gain_at_zero(z, p)


def _landen(k: float) -> list[float]:
    """Moduli of descending Landen transformations, down to nothing."""
    out = []
    while k > 1e-16:
        k = (k / (1 + np.sqrt(1 - k * k))) ** 2
        out.append(k)
    return out


def _ascend(w: np.ndarray, k: float) -> np.ndarray:
    for v in reversed(_landen(k)):
        w = (1 + v) * w / (1 + v * w * w)
    return w


def _cd(u, k: float):
    return _ascend(np.cos(np.asarray(u, complex) * np.pi / 2), k)


def _sn(u, k: float):
    return _ascend(np.sin(np.asarray(u, complex) * np.pi / 2), k)


def _inverse_sn(w: complex, k: float) -> complex:
    before = k
    for v in _landen(k):
        w = 2 * w / ((1 + v) * (1 + np.sqrt(1 - w * w * before * before)))
        before = v
    return 1 - 2 * np.arccos(w) / np.pi


def _elliptic(order: int, ripple: float, attenuation: float) -> Zpk:
    eps = np.sqrt(10 ** (ripple / 10) - 1)
    k1 = eps / np.sqrt(10 ** (attenuation / 10) - 1)
    u = (2 * np.arange(1, order // 2 + 1) - 1) / order
    other = np.sqrt(1 - k1 * k1)
    k = np.sqrt(1 - float(np.real(other**order * np.prod(_sn(u, other) ** 4))) ** 2)  # the degree equation
    v = -1j * _inverse_sn(1j / eps, k1) / order
    z, p = 1j / (k * _cd(u, k)), 1j * _cd(u - 1j * v, k)
    z, p = np.concatenate((z, z.conj())), np.concatenate((p, p.conj()))
    if order % 2:
        p = np.append(p, 1j * _sn(1j * v, k))
    return z, p, _gain_at_zero(z, p, 1.0 if order % 2 else 10 ** (-ripple / 20))


FAMILIES = {
    "butterworth": lambda order, ripple, attenuation: _butterworth(order),
    "chebyshev1": lambda order, ripple, attenuation: _chebyshev_1(order, ripple),
    "chebyshev2": lambda order, ripple, attenuation: _chebyshev_2(order, attenuation),
    "elliptic": _elliptic,
}


def _band(roots: np.ndarray, half: np.ndarray, centre: float) -> np.ndarray:
    root = np.sqrt(half**2 - centre**2 + 0j)
    return np.concatenate((half + root, half - root))


def _pairs(x: np.ndarray) -> list[np.ndarray]:
    """Polynomials of conjugate pairs, then of real roots two by two."""
    up = sorted((v for v in x if v.imag > 1e-12), key=lambda v: -abs(v))
    real = sorted((v.real for v in x if abs(v.imag) <= 1e-12), key=abs, reverse=True)
    return [np.real(np.poly([v, v.conjugate()])) for v in up] + [np.poly(real[i : i + 2]) for i in range(0, len(real), 2)]


def sections(order: int, cut: float | tuple[float, float], kind: str, rate: float, family: str = "butterworth", ripple: float = 1.0, attenuation: float = 40.0) -> np.ndarray:
    """Second-order sections (b0 b1 b2 1 a1 a2) of a digital filter: "low", "high", "band" or "stop"; cut in the unit of ``rate``.
    ``ripple`` of the pass band and ``attenuation`` of the stop band in decibels, for the families that have them."""
    edges = np.atleast_1d(np.asarray(cut, float)) * 2 / rate
    if not ((0 < edges) & (edges < 1)).all():
        raise ValueError("cut-off must lie between zero and half the rate")
    warped = 4 * np.tan(np.pi * edges / 2)
    zeros, poles, gain = FAMILIES[family](order, ripple, attenuation)
    more = len(poles) - len(zeros)
    if kind == "low":
        zeros, poles, gain = zeros * warped[0], poles * warped[0], gain * warped[0] ** more
    elif kind == "high":
        gain *= float(np.real(np.prod(-zeros) / np.prod(-poles)))
        zeros, poles = np.concatenate((warped[0] / zeros, np.zeros(more, complex))), warped[0] / poles
    else:
        width, centre = warped[1] - warped[0], np.sqrt(warped[0] * warped[1])
        if kind == "band":
            gain *= width**more
            zeros, poles = np.concatenate((_band(zeros, zeros * width / 2, centre), np.zeros(more, complex))), _band(poles, poles * width / 2, centre)
        else:
            gain *= float(np.real(np.prod(-zeros) / np.prod(-poles)))
            ends = np.concatenate((np.full(more, 1j * centre), np.full(more, -1j * centre)))
            zeros, poles = np.concatenate((_band(zeros, width / 2 / zeros, centre), ends)), _band(poles, width / 2 / poles, centre)
    gain *= float(np.real(np.prod(4 - zeros) / np.prod(4 - poles)))
    z, p = (4 + zeros) / (4 - zeros), (4 + poles) / (4 - poles)
    z = np.concatenate((z, -np.ones(len(p) - len(z))))
    out = np.array([np.concatenate((np.pad(y, (0, 3 - len(y))), np.pad(x, (0, 3 - len(x))))) for x, y in zip(_pairs(p), _pairs(z))])
    out[0][:3] *= gain
    return out
