"""Settings of an index: from a JSON file, defaults where it has none."""

from __future__ import annotations

import json
from dataclasses import asdict, dataclass, field, fields, replace
from pathlib import Path

from sparkloom.functions.paths import EXTENSIONS

NAME = ".sparkloom.json"
#: Folders and files that no index wants, by what makes them.
DEFAULT_IGNORE = (
    # version control, editors, systems
    ".git/ .hg/ .svn/ .bzr/ CVS/ .idea/ .vscode/ .vs/ *.swp *.swo *~ .DS_Store Thumbs.db desktop.ini "
    # packages and environments
    "node_modules/ bower_components/ jspm_packages/ vendor/ venv/ .venv/ env/ virtualenv/ site-packages/ .tox/ .nox/ __pypackages__/ .pnpm-store/ .yarn/ "
    # what builds leave
    "target/ build/ dist/ out/ bin/ obj/ _build/ cmake-build-*/ CMakeFiles/ .gradle/ .next/ .nuxt/ .svelte-kit/ .turbo/ .parcel-cache/ .output/ *.egg-info/ .eggs/ "
    # caches and reports
    "__pycache__/ .pytest_cache/ .mypy_cache/ .ruff_cache/ .hypothesis/ .cache/ .sass-cache/ .ipynb_checkpoints/ htmlcov/ coverage/ .nyc_output/ .coverage *.lcov "
    # compiled, packed, generated
    "*.pyc *.pyo *.pyd *.so *.dylib *.dll *.exe *.o *.a *.lib *.obj *.class *.jar *.war *.ear *.wasm *.rlib *.pdb *.min.js *.min.css *.map *.bundle.js "
    "*.zip *.tar *.gz *.bz2 *.xz *.7z *.rar *.whl *.deb *.rpm *.dmg *.iso "
    # data and media
    "*.png *.jpg *.jpeg *.gif *.bmp *.ico *.webp *.svg *.mp3 *.mp4 *.wav *.avi *.mov *.ogg *.pdf *.doc *.docx *.xls *.xlsx *.ppt *.pptx *.ttf *.otf *.woff *.woff2 *.eot "
    "*.db *.sqlite *.sqlite3 *.parquet *.npy *.npz *.pkl *.h5 *.onnx *.pt *.bin *.dat "
    # locks, logs, secrets
    "*.lock package-lock.json pnpm-lock.yaml *.log logs/ *.pid *.seed *.tmp *.bak .env *.pem *.key tmp/ temp/"
).split()


@dataclass(frozen=True)
class Config:
    ignore: list[str] = field(default_factory=lambda: list(DEFAULT_IGNORE))
    include: list[str] = field(default_factory=list)
    exclude: list[str] = field(default_factory=list)
    extensions: list[str] = field(default_factory=lambda: sorted(EXTENSIONS))
    use_gitignore: bool = True
    max_size: int = 1 << 20
    budgets: dict[str, int] = field(default_factory=dict)
    debounce_seconds: float = 1.0

    @classmethod
    def load(cls, path: str | Path) -> Config:
        """Settings of a JSON file; a missing file gives the defaults, unknown names are an error."""
        p = Path(path)
        said = json.loads(p.read_text()) if p.exists() else {}
        unknown = set(said) - {f.name for f in fields(cls)}
        if unknown:
            raise ValueError(f"unknown settings in {p}: {', '.join(sorted(unknown))}")
        return cls(**said)

    def save(self, path: str | Path) -> None:
        Path(path).write_text(json.dumps(asdict(self), indent=2, sort_keys=True) + "\n")

    def with_(self, **changes) -> Config:
        """A copy; what is None stays as it was."""
        return replace(self, **{k: v for k, v in changes.items() if v is not None})
