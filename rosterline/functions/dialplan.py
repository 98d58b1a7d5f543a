"""The international dial plan (ITU E.164 assignments) and the lookup of a number's country.

The plan is text, one line a world zone.  ``_cells`` expands it by rule: every
three-digit cell 000–999 gets the longest prefix that covers it, and the North American
zone the same for its area codes.  A lookup is then two array accesses by number; the few
prefixes of more than three digits outside that zone are compared only where their
cell has any.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

__all__ = ["DIAL_PLAN", "AREA_CODES", "dial_country", "iso_of_prefix"]

# Prefix, then ISO-2 country.  Satellite, shared-cost and other international services have no country.
DIAL_PLAN = """
1 US
20 EG 211 SS 212 MA 213 DZ 216 TN 218 LY 220 GM 221 SN 222 MR 223 ML 224 GN 225 CI 226 BF 227 NE 228 TG 229 BJ 230 MU 231 LR 232 SL
233 GH 234 NG 235 TD 236 CF 237 CM 238 CV 239 ST 240 GQ 241 GA 242 CG 243 CD 244 AO 245 GW 246 IO 247 AC 248 SC 249 SD 250 RW 251 ET
252 SO 253 DJ 254 KE 255 TZ 256 UG 257 BI 258 MZ 260 ZM 261 MG 262 RE 263 ZW 264 NA 265 MW 266 LS 267 BW 268 SZ 269 KM 27 ZA 290 SH
291 ER 297 AW 298 FO 299 GL
30 GR 31 NL 32 BE 33 FR 34 ES 350 GI 351 PT 352 LU 353 IE 354 IS 355 AL 356 MT 357 CY 358 FI 359 BG 36 HU 370 LT 371 LV 372 EE 373 MD
374 AM 375 BY 376 AD 377 MC 378 SM 379 VA 380 UA 381 RS 382 ME 383 XK 385 HR 386 SI 387 BA 389 MK 39 IT
40 RO 41 CH 420 CZ 421 SK 423 LI 43 AT 44 GB 45 DK 46 SE 47 NO 48 PL 49 DE
500 FK 501 BZ 502 GT 503 SV 504 HN 505 NI 506 CR 507 PA 508 PM 509 HT 51 PE 52 MX 53 CU 54 AR 55 BR 56 CL 57 CO 58 VE 590 GP 591 BO
592 GY 593 EC 594 GF 595 PY 596 MQ 597 SR 598 UY 599 CW
60 MY 61 AU 62 ID 63 PH 64 NZ 65 SG 66 TH 670 TL 672 NF 673 BN 674 NR 675 PG 676 TO 677 SB 678 VU 679 FJ 680 PW 681 WF 682 CK 683 NU
685 WS 686 KI 687 NC 688 TV 689 PF 690 TK 691 FM 692 MH
7 RU 76 KZ 77 KZ
81 JP 82 KR 84 VN 850 KP 852 HK 853 MO 855 KH 856 LA 86 CN 880 BD 886 TW
90 TR 91 IN 92 PK 93 AF 94 LK 95 MM 960 MV 961 LB 962 JO 963 SY 964 IQ 965 KW 966 SA 967 YE 968 OM 970 PS 971 AE 972 IL 973 BH 974 QA
975 BT 976 MN 977 NP 98 IR 992 TJ 993 TM 994 AZ 995 GE 996 KG 998 UZ
441481 GG 441534 JE 441624 IM 3906698 VA 262269 YT 262639 YT 5993 BQ 5994 BQ 5997 BQ 6189162 CC 6189164 CX 4779 SJ 35818 AX
2125288 EH 6721 AQ
"""

# Area codes of the North American zone (country code 1) outside the United States, by country.
AREA_CODES = """
CA 204 226 236 249 250 257 263 289 306 343 354 365 367 368 382 403 416 418 428 431 437 438 450 468 474 506 514 519 548 579 581 584 587
CA 604 613 639 647 672 683 705 709 742 753 778 780 782 807 819 825 867 873 879 902 905 942
AG 268
AI 264
AS 684
BB 246
BM 441
BS 242
DM 767
DO 809 829 849
GD 473
GU 671
JM 658 876
KN 869
KY 345
LC 758
MP 670
MS 664
PR 787 939
SX 721
TC 649
TT 868
VC 784
VG 284
VI 340
"""


def _pairs() -> dict[str, str]:
    words = DIAL_PLAN.split()
    return dict(zip(words[::2], words[1::2]))


def _areas() -> dict[str, str]:
    return {"1" + code: line.split()[0] for line in AREA_CODES.strip().splitlines() for code in line.split()[1:]}


def iso_of_prefix() -> dict[str, str]:
    """Every prefix of the plan, area codes included."""
    return _pairs() | _areas()


def _cells(plan: dict[str, str], first: str = "") -> list[tuple[str, int]]:
    """(ISO-2 or '', length of its prefix) of the cells 000–999 after ``first``."""
    out = []
    for i in range(1000):
        digits = first + f"{i:03d}"
        hit = max((p for p in plan if digits.startswith(p)), key=len, default="")
        out.append((plan.get(hit, ""), len(hit)))
    return out


def _array(values) -> Column:
    """A constant array of strings: one literal that the optimiser splits once."""
    return F.split(F.lit(",".join(map(str, values))), ",")


def dial_country(body: Column) -> Column:
    """ISO-2 of the longest assigned prefix of ``body``, the digits after the plus sign; NULL if there is none."""
    plan = iso_of_prefix()
    world, zone1 = _cells(_pairs()), _cells(plan, "1")
    # A short number counts with the digits it has: a prefix longer than that is not met.
    n = F.length(body)
    cell = F.rpad(F.substring(body, 1, 3), 3, "0").try_cast("int") + 1
    iso, size = F.element_at(_array(c for c, _ in world), cell), F.element_at(_array(k for _, k in world), cell).cast("int")
    by_cell = F.when((iso != "") & (size <= n), iso)
    # Short bodies of a covered longer prefix fall back to what their own digits say.
    short = F.coalesce(*[F.when(n == k, F.element_at(_array(_short(plan, k)), body.try_cast("int") + 1)) for k in (1, 2)])
    area = F.element_at(_array(c for c, _ in zone1), F.substring(body, 2, 3).try_cast("int") + 1)
    longer = F.lit(None).cast("string")
    for p in sorted((p for p in _pairs() if len(p) > 3), key=len, reverse=True):
        longer = F.coalesce(longer, F.when(body.startswith(p), plan[p]))
    split = sorted({p[:3] for p in _pairs() if len(p) > 3})
    found = (F.when(n < 3, short).when(body.startswith("1") & (n >= 4), F.nullif(area, F.lit("")))
             .when(F.substring(body, 1, 3).isin(*split), F.coalesce(longer, by_cell)).otherwise(by_cell))
    return F.nullif(found, F.lit(""))


def _short(plan: dict[str, str], digits: int) -> list[str]:
    """ISO-2 or '' of the numbers of ``digits`` digits."""
    out = []
    for i in range(10 ** digits):
        d = f"{i:0{digits}d}"
        hit = max((p for p in plan if d.startswith(p)), key=len, default="")
        out.append(plan.get(hit, ""))
    return out
