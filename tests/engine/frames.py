"""Frame builders for the tests."""

import ipaddress
import struct


def ethernet(kind, body, tags=()):
    head = bytes(6) + b"\x02" * 6
    for outer, vid in tags:
        head += struct.pack(">HH", outer, vid)
    return head + struct.pack(">H", kind) + body


def ipv4(src, dst, proto, body, total=None):
    return struct.pack(">2B3H2BH", 0x45, 0, 20 + len(body) if total is None else total, 0, 0, 64, proto, 0) + ipaddress.ip_address(src).packed + ipaddress.ip_address(dst).packed + body


def ipv6(src, dst, proto, body):
    return struct.pack(">IH2B", 6 << 28, len(body), proto, 64) + ipaddress.ip_address(src).packed + ipaddress.ip_address(dst).packed + body


def tcp(sport, dport, flags, body=b""):
    return struct.pack(">2H2I2B3H", sport, dport, 0, 0, 5 << 4, flags, 64240, 0, 0) + body


def udp(sport, dport, body=b""):
    return struct.pack(">4H", sport, dport, 8 + len(body), 0) + body


def arp(op, mac, src, target_mac, target, pad=0):
    raw = lambda m: bytes.fromhex(m.replace(":", ""))
    return ethernet(0x0806, struct.pack(">2H2BH", 1, 0x0800, 6, 4, op) + raw(mac) + ipaddress.ip_address(src).packed + raw(target_mac) + ipaddress.ip_address(target).packed) + bytes(pad)


def name(text):
    return b"".join(bytes([len(x)]) + x.encode() for x in text.rstrip(".").split(".")) + b"\0"


def dns_query(txid, host, qtype=1, flags=0x0100, answers=b"", n=0):
    return struct.pack(">6H", txid, flags, 1, n, 0, 0) + name(host) + struct.pack(">2H", qtype, 1) + answers


def client_hello(sni, suites=(0x1301,)):
    ext = b""
    if sni is not None:
        raw = sni.encode()
        body = struct.pack(">HBH", len(raw) + 3, 0, len(raw)) + raw
        ext = struct.pack(">2H", 0, len(body)) + body
    ext += struct.pack(">2H", 43, 0)
    hello = struct.pack(">H", 0x0303) + bytes(32) + b"\0" + struct.pack(f">H{len(suites)}H", 2 * len(suites), *suites) + b"\1\0" + struct.pack(">H", len(ext)) + ext
    return b"\x16\x03\x01" + struct.pack(">H", len(hello) + 4) + b"\x01" + len(hello).to_bytes(3, "big") + hello
