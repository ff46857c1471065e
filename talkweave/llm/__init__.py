"""Preparing dialogue text for training: markup, language, speech, pairs, packing, mixing, look-alikes."""
