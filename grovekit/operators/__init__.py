"""Dataflow operators, histograms and split measures as DataFrame plans."""
