"""The classifier learns from as many labelled documents as its operator promises."""

from inspect import signature

from curatrix.llm import quality_model


def test_sample_is_not_cut():
    assert signature(quality_model.classify).parameters["per_class"].default >= 1200
