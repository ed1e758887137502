"""Admission of search hits against a loop over tasks and hits."""

from collections import Counter

import numpy as np

from gazette.sources import adapters


def loop(tasks, hits):
    judged, told = [], {}
    for t in tasks:
        seen, skipped, allowed, kept, broad_kept = set(), Counter(), Counter(), 0, 0
        own = sorted((h for h in hits if h["task_id"] == t["task_id"]), key=lambda h: h["pos"])
        for h in own:
            url = " ".join((h["article_url"] or "").split())
            if not url or url in seen:
                skipped["duplicate_or_empty_url"] += 1
                judged.append((h["pos"], False, "duplicate_or_empty_url"))
                continue
            seen.add(url)
            if not h["met"]:
                skipped["no_metadata_or_out_of_range"] += 1
                judged.append((h["pos"], False, "no_metadata_or_out_of_range"))
                continue
            matched, is_broad = list(h["matched_brands"] or []), t["query_strategy"] in adapters.BROAD
            broad = h["broad_reason"] if is_broad or (t["broad_allowed"] and t["needs_commerce"]) else ""
            why = ""
            if t["task_type"] == "report_ranking":
                why = "" if matched and h["report_like"] else "report_not_matched"
            else:
                if t["platform_label"] not in matched:
                    if broad:
                        allowed["broad_entry_platform_context_allowed"] += 1
                    else:
                        why = "platform_not_matched"
                if not why and t["needs_commerce"]:
                    strength = h["commerce"] or ("weak" if broad else "")
                    if not strength:
                        why = h["no_commerce_reason"]
                    elif strength == "weak":
                        allowed["instagram_weak_commerce_allowed"] += 1
                if not why and is_broad and not broad:
                    why = "broad_entry_context_not_matched"
            if why:
                skipped[why] += 1
            else:
                kept += 1
                broad_kept += bool(broad)
            judged.append((h["pos"], not why, why))
        told[t["task_id"]] = (len(own), kept, broad_kept, dict(skipped), dict(allowed))
    return sorted(judged), told


def test_admission_and_diagnostics(spark):
    rng = np.random.default_rng(5)
    tasks = [dict(task_id=f"t{k}", task_type=["related_news", "report_ranking", None][k % 3], platform_label="P", query_strategy=["", "platform_broad_short", "platform_broad_eu_global", None][k % 4], broad_allowed=bool(k % 2), needs_commerce=k % 5 < 2) for k in range(12)]
    pick = lambda *values: values[int(rng.integers(len(values)))]
    hits = [dict(task_id=f"t{rng.integers(11)}", pos=i, article_url=pick("u1", "u2 ", " u2", "u3", "", None, f"x{i}", f"y{i}"), met=pick(True, True, True, False), matched_brands=pick(["P"], ["Q", "P"], ["Q"], [], None), broad_reason=pick("", "market"), report_like=pick(True, False), commerce=pick("", "weak", "strong"), no_commerce_reason="instagram_no_commerce") for i in range(600)]
    t = spark.createDataFrame([tuple(x.values()) for x in tasks], "task_id string, task_type string, platform_label string, query_strategy string, broad_allowed boolean, needs_commerce boolean")
    h = spark.createDataFrame([tuple(x.values()) for x in hits], "task_id string, pos long, article_url string, met boolean, matched_brands array<string>, broad_reason string, report_like boolean, commerce string, no_commerce_reason string")
    judged = adapters.judged_hits(h, t)
    want, told = loop(tasks, hits)
    assert sorted((r["pos"], r["kept"], r["skipped"]) for r in judged.collect()) == want and len({w for _, _, w in want}) == 7
    got = {r["task_id"]: (r["feed_count"], r["kept_count"], r["broad_entry_count"], r["skipped_reason_count"], r["allowed_reason_count"]) for r in adapters.search_diagnostics(judged, t).collect()}
    assert got == told and told["t11"] == (0, 0, 0, {}, {})
    forced = judged.where("kept and array_contains(allowed, 'broad_entry_platform_context_allowed')").first()
    assert forced["matched_brands"] == ["P"] and forced["broad_entry_reason"] == "market"
    assert adapters.judged_hits(h.limit(0), t).count() == 0
