"""The options of a build, checked before anything is read."""

from __future__ import annotations

import math
import os
from dataclasses import dataclass, field

from .sources.frames import INTERVAL, THRESHOLD, check_options

FORMATS = ("slides", "layout", "html")


@dataclass(frozen=True)
class Options:
    """pages counts cover and overview; formats beside JSON, which is always written.

    provider, connector and decoder name what a caller plugs in, as module:factory: a provider of summaries is made with the
    model's name, a connector with nothing; a decoder is a function of an image's bytes and a shape, needed for
        other images than PNG.
    """

    source: str | None = None  # a URL, for the connector
    transcripts: str | None = None
    frames: str | None = None  # a table of chosen frames
    images: str | None = None  # or a folder for each video of extracted images
    logs: str | None = None  # and a folder of the extraction's logs, one file for each video
    title: str | None = None
    pages: int = 200
    reading_minutes: float = 60.0
    duration: float | None = None
    language: str = "en"
    provider: str = "extractive"
    model: str = field(default_factory=lambda: os.environ.get("TIMEDTEXT_MODEL", ""))
    workers: int = 3
    transcript_only: bool = False
    connector: str | None = None
    decoder: str | None = None
    text_only: bool = False  # a provider gets no pictures
    frame_interval: float = INTERVAL
    threshold: float = THRESHOLD
    crop: tuple[float, float, float, float] | None = None
    formats: tuple[str, ...] = FORMATS
    checkpoints: str | None = None
    out: str = "output/book"

    def check(self) -> Options:
        whole = lambda x: isinstance(x, int) and not isinstance(x, bool)
        positive = lambda x: isinstance(x, (int, float)) and not isinstance(x, bool) and math.isfinite(x) and x > 0
        if not whole(self.pages) or self.pages < 3:
            raise ValueError("pages must be 3 or more")
        for name in ("reading_minutes", "frame_interval"):
            if not positive(getattr(self, name)):
                raise ValueError(f"{name} must be finite and positive")
        if self.duration is not None and not positive(self.duration):
            raise ValueError("duration must be finite and positive")
        if not whole(self.workers) or not 1 <= self.workers <= 8:
            raise ValueError("workers must lie between 1 and 8")
        unknown = set(self.formats) - {*FORMATS, "json"}
        if unknown or not self.formats:
            raise ValueError(f"unknown formats: {', '.join(sorted(unknown)) or 'none given'}")
        check_options(self.frame_interval, self.threshold, self.crop, slack=0.0)
        if not self.transcripts and not self.source:
            raise ValueError("no input: give a folder of transcripts, or a source and a connector")
        if self.source and not self.connector:
            raise ValueError("a source needs a connector")
        if bool(self.images) != bool(self.logs):
            raise ValueError("images need logs, and logs images")
        if self.images and self.frames:
            raise ValueError("give frames or images, not both")
        for name in ("provider", "connector", "decoder"):
            value = getattr(self, name)
            if value and value != "extractive" and value.count(":") != 1:
                raise ValueError(f"{name} must be module:factory")
        return self
