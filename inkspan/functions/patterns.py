"""The indicator types with the patterns that find them, a cheap test that a text may hold one, and the confidence of a match.

The patterns must equal those that existing data was extracted with; they are kept free of look-around so that other regex engines read
them alike.
"""

from __future__ import annotations

from typing import NamedTuple


class Pattern(NamedTuple):
    regex: str
    hint: str  # a short regex that every match satisfies, tried first
    confidence: float
    ignore_case: bool = False


_SOCIAL = 1.0

PATTERNS: dict[str, Pattern] = {
    "url": Pattern(r"https?://(?:www\.)?[-a-zA-Z0-9@:%._\+~#=]{1,256}\.[a-zA-Z0-9()]{1,6}\b(?:[-a-zA-Z0-9()@:%_\+.~#?&/=]*)", "://", 0.95, True),
    "domain": Pattern(r"(?:[a-z0-9](?:[a-z0-9-]{0,61}[a-z0-9])?\.)+[a-z0-9][a-z0-9-]{0,61}[a-z0-9]", r"\w\.\w", 0.9, True),
    "ip_address": Pattern(r"\b(?:(?:25[0-5]|2[0-4][0-9]|[01]?[0-9][0-9]?)\.){3}(?:25[0-5]|2[0-4][0-9]|[01]?[0-9][0-9]?)\b", r"\d\.\d", 1.0),
    "email": Pattern(r"\b[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Z|a-z]{2,}\b", "@", 1.0),
    "phone": Pattern(r"[\+]?[(]?[0-9]{1,4}[)]?[-\s\.]?[(]?[0-9]{1,4}[)]?[-\s\.]?[0-9]{1,5}[-\s\.]?[0-9]{1,5}", r"\d", 0.7),
    "md5": Pattern(r"\b[a-fA-F0-9]{32}\b", "[a-fA-F0-9]{32}", 1.0),
    "sha1": Pattern(r"\b[a-fA-F0-9]{40}\b", "[a-fA-F0-9]{40}", 1.0),
    "sha256": Pattern(r"\b[a-fA-F0-9]{64}\b", "[a-fA-F0-9]{64}", 1.0),
    "facebook": Pattern(r"(?:facebook\.com|fb\.com|fb\.me)/(?:pages/)?(?:[\w\-\.]+/?)?(?:posts/)?[\w\-\./]*", "/", _SOCIAL, True),
    "twitter": Pattern(r"(?:twitter\.com|x\.com)/(?:#!/)?(?:\w+)(?:/status(?:es)?/(\d+))?", "/", _SOCIAL, True),
    "instagram": Pattern(r"(?:instagram\.com|instagr\.am)/(?:p/)?(?:[\w\-\.]+/?)?", "/", _SOCIAL, True),
    "youtube": Pattern(r"(?:youtube\.com/(?:watch\?v=|channel/|user/)|youtu\.be/)[\w\-]+", "/", _SOCIAL, True),
    "linkedin": Pattern(r"linkedin\.com/(?:in|company|pub)/[\w\-\.%]+/?", "/", _SOCIAL, True),
    "tiktok": Pattern(r"tiktok\.com/@[\w\-\.]+(?:/video/\d+)?", "/", _SOCIAL, True),
    "telegram": Pattern(r"t\.me/(?:joinchat/)?[\w\-]+", "/", _SOCIAL, True),
    "reddit": Pattern(r"reddit\.com/(?:r|u|user)/[\w\-]+(?:/comments/[\w]+)?", "/", _SOCIAL, True),
    "vk": Pattern(r"vk\.com/(?:id\d+|[\w\-\.]+)", "/", _SOCIAL, True),
    "truth_social": Pattern(r"truthsocial\.com/@[\w\-\.]+", "/", _SOCIAL, True),
    "parler": Pattern(r"parler\.com/(?:profile|post)/[\w\-]+", "/", _SOCIAL, True),
    "google_analytics": Pattern(r"UA-\d{4,10}-\d{1,4}", "UA-", 1.0),
    "adsense": Pattern(r"pub-\d{16}", "pub-", 1.0),
    "bitcoin": Pattern(r"\b[13][a-km-zA-HJ-NP-Z1-9]{25,34}\b", "[a-zA-Z0-9]{26}", 1.0),
    "ethereum": Pattern(r"\b0x[a-fA-F0-9]{40}\b", "0x", 1.0),
}

HASHES = ("md5", "sha1", "sha256")
SOCIAL = ("facebook", "twitter", "instagram", "youtube", "linkedin", "tiktok", "telegram", "reddit", "vk", "truth_social", "parler")
TRACKING = ("google_analytics", "adsense")
CRYPTO = {"bitcoin": "bitcoin", "ethereum": "ethereum"}

#: Domains that are never indicators by themselves.
WHITELIST = (
    "google.com", "microsoft.com", "apple.com", "amazon.com", "cloudflare.com", "github.com", "wikipedia.org", "archive.org", "doi.org", "w3.org",
    "schema.org", "example.com", "localhost", "youtube.com", "twitter.com", "facebook.com", "instagram.com", "linkedin.com", "reddit.com",
)

#: Public suffixes known without a list file; a list can be given instead.
SUFFIXES = tuple(
    """com org net info biz io co me tv cc us uk co.uk org.uk fr de es it pt nl ru eu ch at be pl se no dk fi cz ro bg gr hu ua by kz tr cn jp kr in br com.br mx ar
    au com.au nz ca za site online xyz top club shop app dev ai edu gov mil int name pro mobi su ly to ws""".split()
)

#: IPv4 ranges (first and last address) that no indicator can be in: private and reserved blocks.
RESERVED_IPV4 = (
    ("0.0.0.0", "0.255.255.255"), ("10.0.0.0", "10.255.255.255"), ("127.0.0.0", "127.255.255.255"), ("169.254.0.0", "169.254.255.255"), ("172.16.0.0", "172.31.255.255"),
    ("192.0.0.0", "192.0.0.8"), ("192.0.0.11", "192.0.0.255"), ("192.0.2.0", "192.0.2.255"), ("192.168.0.0", "192.168.255.255"), ("198.18.0.0", "198.19.255.255"),
    ("198.51.100.0", "198.51.100.255"), ("203.0.113.0", "203.0.113.255"), ("240.0.0.0", "255.255.255.255"),
)

#: Loose patterns by which a chunk's indicators are counted, letter case aside.
LOOSE = (
    r"https?://[^\s]+", r"[a-zA-Z0-9._%+-]+@[a-zA-Z0-9.-]+\.[a-zA-Z]{2,}", r"\b(?:[0-9]{1,3}\.){3}[0-9]{1,3}\b", r"\b[a-fA-F0-9]{32}\b", r"\b[a-fA-F0-9]{40}\b", r"\b[a-fA-F0-9]{64}\b",
)

#: Country calling codes that a number in international form may begin with.
CALLING_CODES = tuple(
    """1 7 20 27 30 31 32 33 34 36 39 40 41 43 44 45 46 47 48 49 51 52 53 54 55 56 57 58 60 61 62 63 64 65 66 81 82 84 86 90 91 92 93 94 95 98 212 213 216 218 220 221 222
    225 226 229 230 231 232 233 234 236 237 240 242 244 245 248 249 250 251 252 253 254 255 256 257 258 260 261 262 263 264 265 266 267 268 269 350 351 352 353 354 355 356 357
    358 359 370 371 372 373 374 375 376 377 378 380 381 382 383 385 386 387 389 420 421 423 852 853 855 856 880 886 960 961 962 963 964 965 966 967 968 970 971 972 973 974 975
    976 977 992 993 994 995 996 998""".split()
)
