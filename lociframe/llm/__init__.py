"""Operators for preparing training text at corpus scale; see README, section "Training-data operators"."""
