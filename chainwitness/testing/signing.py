"""Deterministic keys and signatures for test ledgers (RFC 6979)."""

import base64
import hashlib
import hmac

import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql import types as T

from chainwitness.fixed_values import P256_N
from chainwitness.functions.ecdsa import base_multiple
from chainwitness.schemas import PUBLIC_KEY


def private_scalar(tag, device_id):
    digest = hashlib.sha256(f"{tag}|{device_id}".encode()).digest()
    return int.from_bytes(digest, "big") % (P256_N - 1) + 1


def _b64url(n):
    return base64.urlsafe_b64encode(n.to_bytes(32, "big")).rstrip(b"=").decode()


def public_key(tag, device_id):
    x, y = base_multiple(private_scalar(tag, device_id))
    return {"kty": "EC", "crv": "P-256", "x": _b64url(x), "y": _b64url(y)}


def _nonce(secret, digest):
    x = secret.to_bytes(32, "big")
    z = (int.from_bytes(digest, "big") % P256_N).to_bytes(32, "big")
    mac = lambda key, data: hmac.new(key, data, hashlib.sha256).digest()
    k, v = b"\x00" * 32, b"\x01" * 32
    for mark in (b"\x00", b"\x01"):
        k = mac(k, v + mark + x + z)
        v = mac(k, v)
    while True:
        v = mac(k, v)
        candidate = int.from_bytes(v, "big")
        if 0 < candidate < P256_N:
            return candidate
        k = mac(k, v + b"\x00")
        v = mac(k, v)


def sign(secret, message: bytes):
    digest = hashlib.sha256(message).digest()
    k = _nonce(secret, digest)
    r = base_multiple(k)[0] % P256_N
    s = pow(k, -1, P256_N) * (int.from_bytes(digest, "big") + r * secret) % P256_N
    return r.to_bytes(32, "big") + s.to_bytes(32, "big")


@F.pandas_udf(T.StringType())
def sign_udf(tag: pd.Series, device_id: pd.Series, chain_hash: pd.Series) -> pd.Series:
    return pd.Series(
        [
            base64.b64encode(sign(private_scalar(t, d), h.encode())).decode()
            for t, d, h in zip(tag, device_id, chain_hash)
        ]
    )


@F.pandas_udf(PUBLIC_KEY)
def public_key_udf(tag: pd.Series, device_id: pd.Series) -> pd.DataFrame:
    return pd.DataFrame([public_key(t, d) for t, d in zip(tag, device_id)])
