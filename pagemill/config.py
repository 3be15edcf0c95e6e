"""Options of a run."""

from __future__ import annotations

from dataclasses import dataclass, field

from pagemill.functions.tables import DEFAULT_EXCLUDES


@dataclass(frozen=True)
class EngineConfig:
    """What a run reads, keeps and writes; the defaults are those of the command line it replaces."""

    site: str | None = None
    output_dir: str = "output"
    max_depth: int = 3
    max_pages: int = 1_000
    default_excludes: bool = True
    excludes: tuple[str, ...] = ()
    includes: tuple[str, ...] = ()
    respect_robots: bool = True
    robots_agent: str = "pagemill"
    use_external_css: bool = True
    extract_brand: bool = True
    max_images_per_page: int = 100
    drop_unfetched_images: bool = False
    legacy_container_guard: bool = False
    canonical_links: bool = False
    split_pages: bool = False
    markdown: bool = False
    capture_404: bool = False
    partitions: int | None = None
    fields: tuple[str, ...] | None = field(default=None)

    @property
    def exclude_patterns(self) -> tuple[str, ...]:
        """Substrings that drop a URL: the default ones, unless off, and the run's own."""
        return (DEFAULT_EXCLUDES if self.default_excludes else ()) + tuple(restore_pattern(p) for p in self.excludes)

    @property
    def include_patterns(self) -> tuple[str, ...]:
        """Substrings of which a URL must hold one, if there are any."""
        return tuple(restore_pattern(p) for p in self.includes)


def restore_pattern(pattern: str) -> str:
    """A pattern such as ``/home`` that a Windows shell rewrote into a path below its own root, as it was meant."""
    if len(pattern) < 3 or not pattern[0].isascii() or not pattern[0].isalpha() or pattern[1] != ":" or pattern[2] not in "/\\":
        return pattern
    flat = pattern.replace("\\", "/")
    for root in ("C:/Program Files/Git/", "C:/Program Files (x86)/Git/", "C:/msys64/", "C:/cygwin64/"):
        if flat.startswith(root):
            return "/" + flat[len(root) :].lstrip("/")
    return "/" + flat.rsplit("/", 1)[-1]
