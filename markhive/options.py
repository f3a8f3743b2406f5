"""Options shared by dedup and compare (the scripts' command-line flags)."""

from __future__ import annotations

from dataclasses import dataclass, replace

MODES = ("url", "url-title")
PROFILES = ("v1", "v2", "v3")


@dataclass(frozen=True)
class KeyOptions:
    """How two bookmarks are judged equal.

    mode            ``url`` or ``url-title`` (``-m`` / ``-c``)
    decode          ``-d``: decoding that is otherwise off
    strict_protocol ``--strict-protocol``: http and https differ
    ignore_slash    ``--ignore-slash``: ``page`` equals ``page/``
    profile         which decode rules: ``v3`` (default), ``v2``, ``v1``
    """

    mode: str = "url"
    decode: bool = False
    strict_protocol: bool = False
    ignore_slash: bool = False
    profile: str = "v3"

    def __post_init__(self):
        if self.mode not in MODES:
            raise ValueError(f"mode must be one of {MODES}, got {self.mode!r}")
        if self.profile not in PROFILES:
            raise ValueError(f"profile must be one of {PROFILES}, got {self.profile!r}")

    def with_mode(self, mode: str) -> "KeyOptions":
        return replace(self, mode=mode)


@dataclass(frozen=True)
class CompareOptions:
    """Options of the compare scripts (decision D8: v3 rules, strict scheme).

    analysis  ``unique`` (default) or ``intersection`` (``-a``)
    mode      ``url`` or ``url-title`` (``-c``)
    filter    ``-f``: only http, https and ftp links
    decode    ``-d``: percent-decode URLs before comparing
    folder_key ``path`` (default): folders are the same when their full
              paths are; ``name``: when their names are (decision D9)
    """

    analysis: str = "unique"
    mode: str = "url"
    filter: bool = False
    decode: bool = False
    folder_key: str = "path"

    def __post_init__(self):
        if self.analysis not in ("unique", "intersection"):
            raise ValueError(f"analysis must be unique or intersection, got {self.analysis!r}")
        if self.mode not in MODES:
            raise ValueError(f"mode must be one of {MODES}, got {self.mode!r}")
        if self.folder_key not in ("path", "name"):
            raise ValueError(f"folder_key must be path or name, got {self.folder_key!r}")

    def key_options(self) -> KeyOptions:
        return KeyOptions(mode=self.mode, decode=self.decode, strict_protocol=True,
                          ignore_slash=False, profile="v3")
