"""Fixtures and a plain-Python rubric shared by the tests."""

import math
import re

from matricula import fixed_values as V


def plain_rank(profile, unis, acts, feedback=None):
    """The rubric in a few lines of Python, to check the Spark plan against."""
    clamp = lambda x: max(0.0, min(1.0, x))
    r6 = lambda x: math.floor(x * 1e6 + 0.5) / 1e6

    def peak(gap, s):
        return clamp(math.exp(-(gap * gap) / (2 * s * s)) + (0.08 * min(gap / s, 0.5) if gap >= 0 else 0))

    out = []
    for u in unis:
        if profile["scope"] == "usa" and u["country"] != "USA":
            continue
        if profile["scope"] == "international" and u["country"] == "USA":
            continue
        if profile["institution_type"] and profile["institution_type"] != u["type"]:
            continue
        a = peak(profile["gpa"] - u["avg_gpa"], 0.35)
        if profile["sat"] is not None and u["avg_sat"] is not None:
            a = (a + peak(float(profile["sat"] - u["avg_sat"]), 130.0)) / 2
        if u["net_price"] is None:
            cost = 0.5
        else:
            price = u["net_price"]
            if profile["home_state"] and u["state"] and profile["home_state"].upper() != u["state"]:
                price += max(0.0, u["sticker_tuition"] - u["tuition_in_state"])
            cap = profile["max_tuition"]
            cost = (1 - price / 60000) if cap is None else 1.0 if price <= cap else 1 - (price - cap) / max(cap, 1.0)
        majors = {m.lower() for m in u["majors"]}
        fit = 0.5 * (1.0 if profile["intended_major"].lower() in majors else 0.3) + 0.25 + 0.25
        pairs = [(abs(profile[f"pf_{x}"] - 0.5) * 2, 1 - abs(profile[f"pf_{x}"] - u[f"c_{x}"])) for x in V.CULTURE_AXES]
        tw = sum(i for i, _ in pairs)
        culture = 0.5 if tw == 0 else r6(clamp(sum(i * g for i, g in pairs) / tw))
        hits = sum(
            any(any(s.lower() in majors for s in subj) for pat, subj in V.ACTIVITY_SUBJECTS if re.search(pat, t))
            for t in acts
        )
        activities = 0.5 if not acts else r6(clamp(0.5 + 0.5 * hits / len(acts)))
        parts = []
        if u["acceptance_rate"] is not None:
            parts.append((1 - abs(profile["intensity"] - (1 - u["acceptance_rate"])), abs(profile["intensity"] - 0.5) * 2))
        if u["enrollment"] is not None:
            parts.append((1 - abs(profile["scale"] - clamp(u["enrollment"] / 25000)), abs(profile["scale"] - 0.5) * 2))
        pw = sum(w for _, w in parts)
        personality = 0.5 if pw == 0 else r6(clamp(sum(p * w for p, w in parts) / pw))
        comp = [r6(a), r6(clamp(cost)), r6(fit), culture, activities, personality]
        w = [V.DEFAULT_WEIGHTS[c] * (feedback or {}).get(c, 1.0) for c in V.COMPONENTS]
        out.append((u["id"], r6(clamp(sum(x * y for x, y in zip(w, comp)) / sum(w)))))
    return sorted(out, key=lambda x: (-x[1], x[0]))


UNI_SCHEMA = (
    "id string, country string, state string, region string, setting string, type string, avg_gpa double, "
    "avg_sat int, acceptance_rate double, net_price double, sticker_tuition double, tuition_in_state double, "
    "enrollment int, majors array<string>, " + ", ".join(f"c_{a} double" for a in V.CULTURE_AXES)
)


def make_universities(n=60):
    rows = []
    for i in range(n):
        us = i % 5 != 0
        rows.append(
            dict(
                id=f"u{i:03d}", country="USA" if us else "Canada", state=["CA", "NY", "TX"][i % 3] if us else None,
                region="West" if us else "International", setting=V.SETTINGS[i % 3], type=V.INSTITUTION_TYPES[i % 2],
                avg_gpa=2.5 + (i % 16) / 10, avg_sat=900 + i * 10 if us else None,
                acceptance_rate=None if i % 11 == 0 else (5 + i * 13 % 90) / 100,
                net_price=None if i % 7 == 0 else 5000.0 + i * 500, sticker_tuition=20000.0 + i, tuition_in_state=9000.0,
                enrollment=None if i % 13 == 0 else 700 * (1 + i % 50),
                majors=[["Computer Science", "Biology"], ["Music"], ["Law", "Nursing"]][i % 3],
                **{f"c_{a}": (i * (k + 2) % 11) / 10 for k, a in enumerate(V.CULTURE_AXES)},
            )
        )
    return rows


def make_profiles():
    rows = []
    for i in range(12):
        rows.append(
            dict(
                profile_id=i, gpa=2.0 + i / 6, sat=None if i % 3 == 0 else 900 + i * 40, intended_major=["music", "BIOLOGY", "Art"][i % 3],
                max_tuition=None if i % 4 == 0 else 9000.0 + i * 900, home_state=[None, "ca", "NY"][i % 3],
                scope=["usa", "international", "both", "moon"][i % 4], institution_type=[None, "Public"][i % 2],
                intensity=i / 11, scale=1 - i / 11,
                **{f"pf_{a}": 0.5 if (i + k) % 3 else (i + k) % 11 / 10 for k, a in enumerate(V.CULTURE_AXES)},
            )
        )
    return rows


PROFILE_SCHEMA = (
    "profile_id bigint, gpa double, sat int, intended_major string, max_tuition double, home_state string, scope string, "
    "institution_type string, intensity double, scale double, " + ", ".join(f"pf_{a} double" for a in V.CULTURE_AXES)
)


def frame(spark, rows, schema):
    names = [c.strip().split(" ")[0] for c in schema.split(",") if c.strip()]
    return spark.createDataFrame([tuple(r[n] for n in names) for r in rows], schema)
