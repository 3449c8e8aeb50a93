"""Scans of source trees and what surrounds them."""
