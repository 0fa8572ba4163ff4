"""Losses and regularisers with their proximal operators, vectorised."""

from __future__ import annotations

import enum

import numpy as np


class Loss(enum.IntEnum):
    SQUARED = 0
    LAD = 1
    HINGE = 2
    LOGISTIC = 3


class Regularizer(enum.IntEnum):
    NOREG = 0
    L2 = 1
    L1 = 2


def soft(v, t):
    return np.sign(v) * np.maximum(np.abs(v) - t, 0)


def loss_value(loss: Loss, o: np.ndarray, y: np.ndarray) -> float:
    if loss == Loss.SQUARED:
        return float(0.5 * ((o - y) ** 2).sum())
    if loss == Loss.LAD:
        return float(np.abs(o - y).sum())
    if loss == Loss.HINGE:
        return float(np.maximum(1 - y * o, 0).sum())
    return float(np.logaddexp(0, -y * o).sum())


def regularizer_value(reg: Regularizer, lam: float, w: np.ndarray) -> float:
    return float(lam * (0.5 * (w**2).sum() if reg == Regularizer.L2 else np.abs(w).sum() if reg == Regularizer.L1 else 0.0))


def prox_loss(loss: Loss, v: np.ndarray, y: np.ndarray, rho: float) -> np.ndarray:
    """argmin over o of loss(o, y) + ρ/2 (o − v)². Hinge and logistic want y in −1, 1."""
    if loss == Loss.SQUARED:
        return (rho * v + y) / (rho + 1)
    if loss == Loss.LAD:
        return y + soft(v - y, 1 / rho)
    if loss == Loss.HINGE:
        m = y * v
        return np.where(m >= 1, v, np.where(m <= 1 - 1 / rho, v + y / rho, y))
    o = v.copy()
    for _ in range(20):
        p = 1 / (1 + np.exp(np.clip(y * o, -500, 500)))
        step = (rho * (o - v) - y * p) / (rho + p * (1 - p))
        o = o - step
        if np.abs(step).max(initial=0) < 1e-12:
            break
    return o


def prox_regularizer(reg: Regularizer, v: np.ndarray, lam: float, rho: float) -> np.ndarray:
    if reg == Regularizer.NOREG or lam == 0:
        return v
    return rho * v / (rho + lam) if reg == Regularizer.L2 else soft(v, lam / rho)
