"""Scan settings: roots and the extension lists that decide a file's type."""

from __future__ import annotations

from dataclasses import dataclass, field, replace

# The default extension lists, matched case-insensitively.
IMAGE_EXTENSIONS = (
    "jpg", "jpeg", "png", "tiff", "tif", "heic", "heif", "raw", "cr2", "cr3",
    "nef", "arw", "orf", "rw2", "dng", "webp", "avif", "gif", "bmp", "psd",
)
VIDEO_EXTENSIONS = (
    "mp4", "mov", "avi", "mkv", "m4v", "wmv", "flv", "webm", "3gp", "mts", "m2ts", "ts",
)


@dataclass(frozen=True)
class ScanSettings:
    """What to scan and how to tell images and videos apart.

    ``roots`` are scanned in the given order. Extension lists hold lower-case names
    without the dot; an extension in both lists counts as an image.
    """

    roots: tuple[str, ...] = ()
    image_extensions: tuple[str, ...] = field(default=IMAGE_EXTENSIONS)
    video_extensions: tuple[str, ...] = field(default=VIDEO_EXTENSIONS)

    def with_roots(self, *paths: str) -> "ScanSettings":
        """Copy with new roots; backslashes become forward slashes."""
        return replace(self, roots=tuple(p.replace("\\", "/") for p in paths))

    @classmethod
    def from_dict(cls, data: dict | None) -> "ScanSettings":
        """Build from a parsed config mapping (``{"scan": {...}}`` or the inner mapping).

        Keys that are absent keep their defaults; unknown keys are ignored.
        """
        scan = (data or {}).get("scan", data) or {}
        known = {
            name: tuple(scan[name])
            for name in ("roots", "image_extensions", "video_extensions")
            if scan.get(name) is not None
        }
        return cls(**known)

    def to_dict(self) -> dict:
        return {
            "scan": {
                "roots": list(self.roots),
                "image_extensions": list(self.image_extensions),
                "video_extensions": list(self.video_extensions),
            }
        }
