"""Acquisition metadata in page descriptions: key = value lines, and how pages map to frames."""

from __future__ import annotations

import json
import re

from pyspark.sql import Column
from pyspark.sql import functions as F

# Names that the common acquisition software writes.
KEYS = {
    "channels": r"SI\.hChannels\.channelSave\s*=\s*\[?([0-9;, ]+)\]?", "slices": r"SI\.hStackManager\.(?:actualNumSlices|numSlices)\s*=\s*(\d+)",
    "volumes": r"SI\.hStackManager\.(?:actualNumVolumes|numVolumes)\s*=\s*(\d+)", "per_slice": r"SI\.hStackManager\.framesPerSlice\s*=\s*(\d+)", "rate": r"SI\.hRoiManager\.scanFrameRate\s*=\s*([0-9.]+)",
}


def parse(text: str) -> dict:
    """Numbers of channels, slices, volumes and frames per slice, and the frame rate, from text or JSON; missing ones are 1 or None."""
    try:
        loaded = json.loads(text)
        text = "\n".join(f"{k} = {v}" for k, v in loaded.items()) if isinstance(loaded, dict) else text
    except ValueError:
        pass
    found = {k: m[1] if (m := re.search(p, text)) else None for k, p in KEYS.items()}
    channels = len(re.findall(r"\d+", found["channels"])) if found["channels"] else 1
    number = lambda k: int(found[k]) if found[k] else 1
    return {"channels": channels, "slices": number("slices"), "volumes": number("volumes"), "per_slice": number("per_slice"), "rate": float(found["rate"]) if found["rate"] else None}


def interleave(text: str, pages: int) -> int:
    """How many channels are stored in turn: those of the metadata if the pages are as many as it says, else 1."""
    m = parse(text)
    return m["channels"] if m["channels"] * m["slices"] * m["volumes"] * m["per_slice"] == pages else 1


def field(text: Column, name: str) -> Column:
    """One of the names of ``KEYS`` as text, for tables of descriptions."""
    return F.regexp_extract(text, KEYS[name], 1)
