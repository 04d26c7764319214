"""Constants of the scalar quantizers, and sizes derived from the dimension."""

from __future__ import annotations

import math

import numpy as np

# Lloyd-Max quantizers of a unit normal.
_CENTROIDS = {
    2: (-1.5104, -0.4528, 0.4528, 1.5104),
    3: (-2.1520, -1.3439, -0.7560, -0.2451, 0.2451, 0.7560, 1.3439, 2.1520),
    4: (-2.7326, -2.0690, -1.6180, -1.2562, -0.9424, -0.6424, -0.3685, -0.1227, 0.1227, 0.3685, 0.6424, 0.9424, 1.2562, 1.6180, 2.0690, 2.7326),
}
_BOUNDARIES = {
    2: (-0.9816, 0.0, 0.9816),
    3: (-1.7480, -1.0500, -0.5006, 0.0, 0.5006, 1.0500, 1.7480),
    4: (-2.4008, -1.8435, -1.4372, -1.0993, -0.7996, -0.5224, -0.2582, 0.0, 0.2582, 0.5224, 0.7996, 1.0993, 1.4372, 1.8435, 2.4008),
}
# Mean squared error that the first stage leaves, by bits.
_RESIDUAL_ENERGY = {2: 0.11767, 3: 0.03454, 4: 0.00961}


def get_codebook(bits: int) -> tuple[np.ndarray, np.ndarray]:
    """(centroids, boundaries) in rising order."""
    if bits not in _CENTROIDS:
        raise ValueError(f"bits must be 2, 3 or 4; got {bits}")
    return np.array(_CENTROIDS[bits]), np.array(_BOUNDARIES[bits])


def half_centroids(bits: int) -> np.ndarray:
    """The centroids as scans use them: rounded to half precision."""
    return get_codebook(bits)[0].astype(np.float16).astype(np.float64)


def residual_scale(bits: int) -> float:
    if bits not in _RESIDUAL_ENERGY:
        raise ValueError(f"bits must be 2, 3 or 4; got {bits}")
    return math.sqrt(_RESIDUAL_ENERGY[bits])


def padded_dim(dim: int) -> int:
    """The next power of two."""
    return 1 << max(dim - 1, 0).bit_length() if dim > 1 else 1


def signs(dim: int, seed: int) -> np.ndarray:
    """The rotation's signs: +1 and -1, drawn from the seed."""
    return np.random.default_rng(seed).choice(np.array([-1.0, 1.0], np.float32), size=dim).astype(np.float64)


def projection(pdim: int, seed: int) -> np.ndarray:
    """The Gaussian matrix of the inner-product correction."""
    return np.random.default_rng(seed + 1337).standard_normal((pdim, pdim)).astype(np.float32).astype(np.float64)
