"""Registered queries; importing this package's ``catalogue`` loads them all."""
