"""Where browsers keep their bookmarks on this machine."""

from __future__ import annotations

from pathlib import Path

#: Folders of Chromium profiles below the home folder, by system.
FOLDERS = {
    "linux": (".config/google-chrome", ".config/chromium", ".config/microsoft-edge", ".config/BraveSoftware/Brave-Browser", ".config/vivaldi"),
    "darwin": ("Library/Application Support/Google/Chrome", "Library/Application Support/Chromium", "Library/Application Support/Microsoft Edge", "Library/Application Support/BraveSoftware/Brave-Browser", "Library/Application Support/Vivaldi"),
    "win32": ("AppData/Local/Google/Chrome/User Data", "AppData/Local/Chromium/User Data", "AppData/Local/Microsoft/Edge/User Data", "AppData/Local/BraveSoftware/Brave-Browser/User Data", "AppData/Local/Vivaldi/User Data"),
}


def bookmark_files(home: str, system: str) -> list[str]:
    """The bookmark files of all profiles, the last changed first; those that can't be looked at are left out."""
    found = []
    for folder in FOLDERS.get(system, ()):
        base = Path(home) / folder
        for profile in ("Default", "Profile *"):
            try:
                found += [(p.stat().st_mtime, str(p)) for p in base.glob(f"{profile}/Bookmarks") if p.is_file()]
            except OSError:
                continue
    return [p for _, p in sorted(found, key=lambda x: (-x[0], x[1]))]
