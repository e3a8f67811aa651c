"""Labelled findings for the secret scan: built by rule, the same on every run.

Each row has the text before and after a candidate, the candidate, a path and a label
(1: a secret). Random-looking values come from hashes of a counter.
"""

from __future__ import annotations

import base64
import hashlib

# Words near secrets, words near harmless values, and harmless identifiers.
KEYWORDS = ["token", "secret", "password", "api_key", "apikey", "passwd", "auth_token", "client_secret", "access_key", "pwd", "credential", "bearer"]
HARMLESS = ["commit", "sha256", "md5", "checksum", "digest", "revision", "hash", "etag", "build", "integrity", "fingerprint", "changeset"]
NUMBERED = ["order", "invoice", "phone", "tel", "isbn", "card", "account", "timestamp", "serial", "tracking", "call", "number"]
PLACEHOLDERS = ["your_token_here_1", "changeme12345", "example_password_1", "xxxxxxxxxxxx1", "insert_key_here_2", "test_secret_value_1", "placeholder-123", "my_api_key_example_1", "dummy_token_0000", "sample-password-01", "000000000000000", "1234567890123456"]
NAMES = ["image_1024x768_final", "test_user_name_01", "file-backup-2023-01-02", "release-notes-2024", "python3-site-packages", "user_profile_page_2", "data/table/part-00001", "usr/local/lib/python3", "article/2023/title-of-page", "section_header_12_main", "window_size_1920x1080", "version-1-2-3-beta4"]
PATHS = ["src/app/config.py", "deploy/settings.env", "src0", "src7", "notes.txt", "src12"]
TEST_PATHS = ["tests/fixtures/data.py", "docs/example.md", "examples/sample.txt", "src3", "src15"]
PROSE = ["the of and then it was so", "que de la para con", "und der die nicht auch", "les des dans pour avec", "words before it here", "as it is on this"]


def _hex(i: int, n: int) -> str:
    return hashlib.sha512(f"finding {i}".encode()).hexdigest()[:n]


def _mixed(i: int, n: int) -> str:
    return base64.b64encode(hashlib.sha512(f"mixed {i}".encode()).digest()).decode()[:n].replace("=", "A")


def _upper(i: int, n: int) -> str:
    return base64.b32encode(hashlib.sha512(f"upper {i}".encode()).digest()).decode()[:n]


def labelled_findings(rounds: int = 24) -> list[dict]:
    rows = []

    def add(before: str, value: str, after: str, path: str, label: int) -> None:
        rows.append({"before": before, "value": value, "after": after, "path": path, "label": label})

    for i in range(rounds):
        key, harmless, number = KEYWORDS[i % len(KEYWORDS)], HARMLESS[i % len(HARMLESS)], NUMBERED[i % len(NUMBERED)]
        prose, path, test = PROSE[i % len(PROSE)], PATHS[i % len(PATHS)], TEST_PATHS[i % len(TEST_PATHS)]
        for n, v in ((40, _hex(i, 40)), (18, _hex(i + 100, 18)), (32, _hex(i + 200, 32)), (28, _mixed(i, 28)), (64, _hex(i + 300, 64))):
            add(f'{prose} {key} = "', v, f'" {prose}', path, 1)
            add(f"{prose} {key}=", v, f" {prose}", path, 1)
            add(f"{prose} {harmless} {'' if n % 3 else ': '}", v, f" {prose}", test if i % 2 else path, 0)
        add(f"{prose} ", "AKIA" + _upper(i, 16), f" {prose}", path, 1)
        add(f"{key}: ", "AKIA" + _upper(i + 50, 16), "\n", path, 1)
        add(f"{prose} ", "ghp_" + _mixed(i + 50, 36).replace("/", "x").replace("+", "y"), f" {prose}", path, 1)
        add(f"{prose} ", "sk-" + _mixed(i + 90, 44).replace("/", "x").replace("+", "y"), f" {prose}", path, 1)
        add(f"{prose} ", _mixed(i + 400, 40), f" {prose}", path, 1)
        add(f"{prose} {key}: ", _mixed(i + 500, 14) + "7!", " ", path, 1)
        h = _hex(i + 600, 32)
        add(f"{prose} id ", f"{h[:8]}-{h[8:12]}-{h[12:16]}-{h[16:20]}-{h[20:]}", f" {prose}", path, 0)
        add(f"{prose} {number} ", str(int(_hex(i + 700, 20), 16))[: 12 + i % 8], f" {prose}", path, 0)
        add(f"{prose} ", str(int(_hex(i + 800, 20), 16))[: 13 + i % 6], f" {prose}", path, 0)
        add(f'{key} = "', PLACEHOLDERS[i % len(PLACEHOLDERS)], '"', test, 0)
        add(f"{key}=", PLACEHOLDERS[(i + 5) % len(PLACEHOLDERS)], " ", path, 0)
        add(f"{prose} ", NAMES[i % len(NAMES)], f" {prose}", path, 0)
        add("see http://www.example.com/", NAMES[(i + 3) % len(NAMES)], f" {prose}", test, 0)
        add(f"{prose} ", f"{PROSE[i % 6].replace(' ', '')}{i}", f" {prose}", path, 0)
        add(f"{prose} /home/user/", f"thing/{_hex(i + 900, 8)}/page{i}", f" {prose}", test, 0)
    return rows
