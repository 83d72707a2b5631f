from auditframe.operators import lifecycle

REVIEWS = [("a", "pending", 1, 0), ("a", "approved", 2, 1), ("b", "approved", 5, 2), ("b", "pending", 5, 3), ("c", "odd", 1, 4)]


def test_latest_decision_and_its_counts(rows):
    reviews = rows(REVIEWS, "artifact_id string, decision string, ts int, seq int")
    assert {r.artifact_id: r.decision for r in lifecycle.latest_review_status(reviews).collect()} == {
        "a": "approved", "b": "pending", "c": "odd"}
    assert [r.artifact_id for r in lifecycle.pending_reviews(reviews).collect()] == ["b"]
    assert {r.decision: r.artifact_count for r in lifecycle.review_summary(reviews).collect()} == {
        "pending": 1, "approved": 1, "rejected": 0, "request_changes": 0, "odd": 1}


def test_transitions(rows):
    history = rows(
        [("e1", "new", "ingested"), ("e1", "new", "analyzed"), ("e1", "ingested", "analyzed"), ("e1", "finalized", "new"),
         ("e2", "new", "ingested"), ("e1", "lost", "new")],
        "engagement_id string, from_state string, to_state string",
    )
    artifacts = rows(
        [("e1", "repo_inventory"), ("e1", "db_schema"), ("e1", "topology"), ("e1", "notes")], "engagement_id string, artifact_type string")
    got = {(r.engagement_id, r.from_state, r.to_state): (r.legal, sorted(r.missing), r.valid)
           for r in lifecycle.validate_transitions(history, artifacts).collect()}
    assert got == {
        ("e1", "new", "ingested"): (True, [], True),
        ("e1", "new", "analyzed"): (False, [], False),
        ("e1", "ingested", "analyzed"): (True, ["cost_drivers", "risk_register"], False),
        ("e1", "finalized", "new"): (False, [], False),
        ("e2", "new", "ingested"): (True, ["db_schema", "repo_inventory"], False),
        ("e1", "lost", "new"): (False, [], False),
    }
    assert [r.valid for r in lifecycle.validate_transitions(history).collect()] == [True, False, True, False, True, False]


def test_lookups(rows):
    states = rows([("new",), ("finalized",), ("lost",)], "state string")
    assert [r.next_states for r in lifecycle.next_states(states).collect()] == [["ingested"], [], []]
    steps = rows([("analyzed", "reviewed"), ("new", "reviewed")], "from_state string, to_state string")
    assert [r.required_artifacts for r in lifecycle.required_artifacts(steps).collect()] == [["review_approval"], []]
